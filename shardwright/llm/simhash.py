"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, meet_hot
from .components import connected_components
from .near_copies import near_copies

#: Fingerprints whose variants one task makes.
TASK_NODES = 20_000
#: Rows of a table that may be sent whole to every executor; counted before it is.
BROADCAST_ROWS = 100_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one UTF-8 text, unsigned.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of `shingle` words, repeats included, are
    joined by one space and hashed by XXH64.  With fewer words the whole sequence is the only shingle, with none the
    fingerprint is 0.  A bit is 1 if it is set in over half of the hashes.
    """
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()  # on bytes, both treat ASCII only
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= shingle:
        return xxh(buf, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 15):
        h = np.array([xxh(buf[s:e], seed) for s, e in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number.  A null text counts as empty (fingerprint 0)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = [fingerprint(v.as_py() or b"", shingle) for v in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))


def ball_edges(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp: long) to edges (a, b) that join exactly those within `radius` bits into components.

    Every fingerprint emits all variants within half the radius.  Two fingerprints within the (even) radius share a
    variant, their midpoint, and whatever shares a variant is within the radius: a variant's group holds at most the
    ball around it (65 for radius 2) and is linked to its smallest member, not pairwise.  The groups of two or more
    are found first by counting (partial sums before the shuffle); only their variants are joined.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius: 0, 2 or 4")
    flips = [0] + [1 << i for i in range(64)] if radius else [0]
    if radius == 4:
        flips += [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    # A fingerprint is 8 bytes and becomes len(flips) rows: Spark, which deals by bytes, would give too many to a task.
    nodes = nodes.repartition(max(1, -(-nodes.count() * len(flips) // (65 * TASK_NODES))), "fp")
    if radius == 4:
        variants = nodes.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"))
    else:
        variants = nodes.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in signed))).alias("v"))
    met = cut(variants.groupBy("v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("v", "b"))
    small = met.count() <= BROADCAST_ROWS
    pairs = variants.join(F.broadcast(met) if small else met, "v").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate groups: (doc_id, fingerprint: 16 hex digits, component_id: smallest id reachable, itself included).

    One row for each row of docs.  Equal fingerprints are one node of the graph, so a group of exact copies of any
    size costs one node, and its rows are met where they lie.  Null text: empty.  Documents without words share fingerprint 0 and are linked like others.
    Rows repeating an id stay separate rows.  A null id is linked but is never the smallest; a component of only null
    ids has a null component.  An empty table gives no rows; other columns are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows")))
    comps = connected_components(ball_edges(nodes.select("fp"), radius))
    rooted = nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(rooted.join(lowest, "root").select("fp", "rows", "component_id"))
    out = meet_hot(fps, by_fp, "fp", "rows", fps.count())
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def ball_pairs(rows: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Pairs (a > b) of nodes that ball hashing finds among rows (node, t): of one fingerprint with its smallest node, and the
    smallest nodes of fingerprints within `radius` bits that are linked."""
    fps = cut(fingerprints(rows, "node", "t", shingle).distinct())
    low = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    same = fps.join(low, "fp").where("id <> low").select(F.col("id").alias("x"), F.col("low").alias("y"))
    near = ball_edges(low.select("fp"), radius)
    near = near.join(low.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select("x", "y")
    return same.unionByName(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """docs without those that have a smaller id in their group: one document of each group stays, all columns kept.

    Groups are linked by pairs of shingle similarity `least` or more.  Ball hashing finds the closest pairs; those beyond
    its radius, which 64 bits cannot tell from others (at a similarity of 0.8 about ten bits differ), come from bands (near_copies).
    Every pair is verified by its whole shingle sets, and kept only if they are similar enough.

    Null texts are empty and equal to each other.  Rows with a null id are kept.  Rows repeating an id are one document
    and stay or go together.  An empty table gives no rows.
    """
    c = near_copies(docs, id_col, text_col, shingle, least, lambda rows: ball_pairs(rows, shingle, radius))
    gone = c.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
