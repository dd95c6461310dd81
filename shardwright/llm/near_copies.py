"""Near copies by shingle similarity: MinHash bands find pairs, exact shingle sets decide them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, meet_hot
from .components import connected_components

#: Bands and the minima in each: two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 for s = 0.8.
BANDS, ROWS = 20, 5
#: Orders by which a band's group chooses the member that the others are compared with; bands take turns.
ORDERS = 5
#: First members that the others of a group are compared with, turn by turn. In the last turn that is every two members of the
#: groups of no more members; larger groups go to blocks.
HUBS = (1, 4, 16)
#: Shingles in a block of a large group, whose members a task compares with those of another block.
BLOCK_SHINGLES = 1 << 18
#: Rows of a table that may be sent whole to every executor; counted before it is.
BROADCAST_ROWS = 100_000


def shingles(text: bytes, shingle: int = 5) -> set:
    """The distinct shingles of one UTF-8 text: `shingle` words (A-Z lower-cased, runs without ASCII white space) joined by one space.

    With fewer words the whole sequence is the only shingle; with none that is the empty one.
    """
    words = text.lower().split()  # on bytes, both treat ASCII only
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def similarity(a: set, b: set) -> float:
    """Shared shingles over all shingles of both."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


@functools.cache
def _odd(seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: set, seed: int = 42):
    """BANDS numbers, each of ROWS minima over the hashed shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    odd = _odd(seed)
    h = np.fromiter((xxh(s, seed) for s in found), np.uint64, len(found))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 2048):
            x = (h[k : k + 2048] ^ (h[k : k + 2048] >> np.uint64(29))) * odd
            low = np.minimum(low, x.min(axis=1))
        x, out = low.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            out = (out ^ x[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _banded(nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, t) to (node, n: distinct shingles, bands)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, found = [], []
            for v in b.column(1).cast(pa.binary()):
                s = shingles(v.as_py() or b"", shingle)
                n.append(len(s))
                found.append(bands(s).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "n", "bands"])

    return nodes.mapInArrow(run, "node bigint, n bigint, bands array<bigint>")


def _verified(pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those (a, b) of pairs (a, b, ta, tb) whose texts are of similarity `least` or more. Pairs lie sorted by a, whose shingles are made once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, ta, tb = batch.columns
            ta, tb = ta.cast(pa.binary()), tb.cast(pa.binary())
            keep = pa.array([similarity(shingles(x.as_py(), shingle), shingles(y.as_py(), shingle)) >= least for x, y in zip(ta, tb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _to_verify(rest: DataFrame, hubs: int, turn: int, least: float, known: DataFrame | None) -> DataFrame:
    """Pairs (a > b, with their group) of the members of each group with its first `hubs` members in the order of this turn.

    known: (node, root) of nodes that are linked already; pairs of one root, which are in one component, need no look.
    """
    order = F.struct(F.xxhash64("node", F.col("band") % ORDERS, F.lit(turn)).alias("x"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    if hubs == 1:
        first = rest.groupBy("band", "key").agg(F.min(order).alias("o")).select("band", "key", "o.hub", "o.hub_n")
    else:
        w = Window.partitionBy("band", "key").orderBy("o")
        first = rest.withColumn("o", order).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= hubs).select("band", "key", "o.hub", "o.hub_n")
    if known is not None:
        roots = known.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
        first = first.join(roots, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
        rest = rest.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = cut(first)
    near = rest.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["band", "key"]).where("node <> hub")
    if known is not None:
        near = near.where("root <> hub_root")
    # Sets whose sizes differ more cannot be similar enough.
    near = near.where(F.least("n", "hub_n") >= F.greatest("n", "hub_n") * (least - 1e-9))
    return near.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, t) to (node, h: the sorted 64-bit hashes of its distinct shingles)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as xxh

        for b in batches:
            found = [np.unique(np.array([xxh(s) for s in shingles(v.as_py(), shingle)], np.uint64)).tobytes() for v in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "h"])

    return texts.select("node", "t").mapInArrow(run, "node bigint, h binary")


def _shared(a: list, b: list, most: int = 1 << 21):
    """How many numbers each array of a shares with each of b (arrays of distinct numbers), by products of matrices of at most `most` cells."""
    import numpy as np

    flat, of = [np.concatenate(x) for x in (a, b)], [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out, step = np.zeros((len(a), len(b)), np.int64), max(1, most // max(len(a), len(b)))
    at = [np.searchsorted(both, f) for f in flat]
    known = [(k < len(both)) & (both[np.minimum(k, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for k, f in zip(at, flat, strict=True)]
    for first in range(0, len(both), step):
        width, m = min(step, len(both) - first), []
        for k in range(2):
            ok = known[k] & (at[k] >= first) & (at[k] < first + width)
            x = np.zeros((len((a, b)[k]), width), np.float32)
            x[of[k][ok], at[k][ok] - first] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _in_blocks(rest: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a > b) that join exactly those members of each group (band, key, node, n) into components that are in one by pairs of similarity
    `least` or more, together with what is known.

    Members of the group's most frequent root are not compared with each other.  The others, and those by themselves, are dealt to blocks of
    about BLOCK_SHINGLES shingles; a task takes two blocks with the 64-bit hashes of their whole shingle sets, counts what every two
    members share and returns a forest of the links: rows follow the members, not their pairs, and no task holds more than two blocks.
    """
    group = ["band", "key"]
    rest = cut(rest.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = rest.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("c")).groupBy(*group).agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rest = rest.join(main, group).withColumn("apart", F.col("root") != F.col("main"))
    blocks = lambda of: F.ceil(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES).cast("int")
    sizes = rest.groupBy(*group).agg(blocks(F.col("apart")).alias("p"), blocks(~F.col("apart")).alias("q"))
    rest = rest.join(sizes, group)
    own = F.when(F.col("apart"), F.pmod(F.xxhash64("node"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), "q")).cast("int")
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("apart"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)))
    rest = rest.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    hashed = cut(_hashed(texts.join(rest.select("node").distinct(), "node", "left_semi"), shingle))

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("node", kind="stable")
        h = [np.frombuffer(x, np.uint64) for x in pdf.h]
        node, root, own = pdf.node.to_numpy(), pdf.root.to_numpy(), pdf.own.to_numpy()
        left, right = np.flatnonzero(own == pdf.i.iloc[0]), np.flatnonzero(own == pdf.j.iloc[0])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        n = np.array([len(x) for x in h])
        both = _shared([h[k] for k in left], [h[k] for k in right])
        x, y = np.nonzero((both / (n[left][:, None] + n[right] - both) >= least) & (root[left][:, None] != root[right]))
        # Roots are the nodes of the forest: links within one tree add nothing.
        up = {}

        def top(r):
            while r in up:
                r = up[r]
            return r

        links = []
        for k, m in zip(left[x].tolist(), right[y].tolist(), strict=True):
            a, b = top(root[k]), top(root[m])
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((max(node[k], node[m]), min(node[k], node[m])))
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rest.join(hashed, "node").groupBy(*group, "i", "j").applyInPandas(run, "a bigint, b bigint").distinct()


def _left(rest: DataFrame, hubs: int, turn: int) -> DataFrame:
    """The groups without the hubs of this turn, which have been compared with all members; groups of one are done."""
    w = Window.partitionBy("band", "key").orderBy(F.xxhash64("node", F.col("band") % ORDERS, F.lit(turn)), "node")
    left = rest.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > hubs).drop("nth")
    many = left.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "key")
    return left.join(many, ["band", "key"], "left_semi")


def _labels(edges: DataFrame, steps: int = 2) -> DataFrame:
    """(node, root): of each linked node the smallest within a few links, so that the members of one star have one root.

    Nodes of equal roots are in one component; it takes connected_components() to find the root of a whole component.
    """
    both = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    out = both.groupBy("node").agg(F.least(F.min("b"), F.min("node")).alias("root"))
    for _ in range(steps - 1):
        next_ = out.select(F.col("node").alias("at"), F.col("root").alias("up"))
        out = out.join(next_, F.col("root") == F.col("at")).select("node", F.col("up").alias("root"))
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Groups of texts of shingle similarity `least` or more: (doc_id, component_id: smallest id reachable, itself included).

    One row for each row of docs.  Equal texts are one node.  Two texts of similarity `least` share one of BANDS bands
    with a probability of 0.9996 at 0.8.  In a band's group all members are compared with the first of it, in the next turn what is not
    linked yet with the next ones; then every two members of groups of up to 16 that are left are compared, and larger groups
    go to blocks (_in_blocks), until every two members of every group are in one component or have been compared: no link of a
    group is lost, groups of near copies settle in the first turns, and tables of pairs follow the members, not their square.
    more: a function of the rows (node, t) that gives further pairs (a > b) to look at.  Every pair is decided by its whole
    shingle sets, in blocks by their 64-bit hashes.

    Null text: empty; texts without words are equal.  A null id is linked but is never the smallest; a component of only null
    ids has a null component.  Rows repeating an id stay separate rows.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).withColumn("node", F.xxhash64("t"))
    sized = cut(_banded(rows.select("node", "t"), shingle).dropDuplicates(["node"]))
    keys = sized.select("node", "n", F.posexplode("bands").alias("band", "key"))
    met = cut(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "key"))
    rest = cut(keys.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, ["band", "key"]))
    told = cut(more(rows.select("node", "t"))) if more is not None else None
    wanted = rest.select("node")
    if told is not None:
        wanted = wanted.unionByName(told.select(F.col("a").alias("node"))).unionByName(told.select(F.col("b").alias("node")))
    wanted = cut(wanted.distinct())
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "node", "left_semi")
    texts = cut(texts.select("node", "t").dropDuplicates(["node"]))

    def links(pairs):
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        return cut(_verified(with_a.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b"), least, shingle))

    edges, known = None, None
    for turn, hubs in enumerate(HUBS):
        if turn and not rest.limit(1).count():
            break
        if turn == len(HUBS) - 1:
            many = rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hubs).select("band", "key")
            large = cut(rest.join(many, ["band", "key"], "left_semi"))
            if large.limit(1).count():
                edges = edges.unionByName(cut(_in_blocks(large, known, texts, shingle, least)))
                rest = cut(rest.join(many, ["band", "key"], "left_anti"))
        pairs = cut(_to_verify(rest, hubs, turn, least, known))
        pairs = pairs.unionByName(told).distinct() if told is not None else pairs
        found, told = links(pairs), None
        edges = found if edges is None else edges.unionByName(found)
        if turn == len(HUBS) - 1:
            break
        known = cut(_labels(edges))
        rest = _left(rest, hubs, turn).join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Groups whose members have one root are done.
        apart = rest.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
        rest = cut(rest.drop("root").join(apart, ["band", "key"], "left_semi"))
    known = cut(connected_components(edges))
    ids = cut(rows.select("id", "node"))
    lows = ids.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    rooted = lows.join(known, "node", "left").select("node", "low", "rows", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = cut(rooted.join(lowest, "root").select("node", "rows", "component_id"))
    return meet_hot(ids, by_node, "node", "rows", ids.count()).select(F.col("id").alias(id_col), "component_id")
