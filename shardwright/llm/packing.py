"""Best-fit packing under conflicts of source and duplicate cluster."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, cut


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int = 2) -> list[int]:
    """The bin of each item, taken in the order given: the fullest bin with room that is compatible, else a new one.

    Bins lie in a list ordered by residual.  A bin carries a bitmap of its duplicate clusters and, for each of the
    `per_source` places a source has in it, a bitmap of sources; it is compatible if the item's cluster bit is clear
    (cluster -1: none) and its source's bit is clear in the last of those maps.  The search starts at the tightest
    residual that fits and goes on to successors until a bin is compatible.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    by_source: list[list[int]] = []
    by_cluster: list[int] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        sbit, cbit, found = 1 << s, 1 << c if c >= 0 else 0, -1
        for k in range(bisect.bisect_left(order, (size, -1)), len(order)):
            b = order[k][1]
            if not by_source[b][-1] & sbit and not by_cluster[b] & cbit:
                found = k
                break
        if found >= 0:
            left, b = order.pop(found)
        else:
            left, b = capacity, len(by_source)
            by_source.append([0] * per_source)
            by_cluster.append(0)
        maps = by_source[b]
        for k in range(per_source):
            if not maps[k] & sbit:
                maps[k] |= sbit
                break
        by_cluster[b] |= cbit
        bisect.insort(order, (left - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, shard_items: int = 4096, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Training sequences of at most `capacity` words: bin_id, doc_id, source, cluster, piece, first_word, n_words, bin_words.

    Texts longer than a bin are split.  Their full pieces are bins of their own (bin_id below 0), written where they are
    found; the rest of a text is an item.  Items are counted and dealt by hash into shards of about `shard_items`,
    whatever the size of the input, and each shard packs its items, largest first, by best_fit(): no two pieces of one
    duplicate cluster (equal texts up to case and white space) share a bin, and no more than `per_source` of one source.
    No row is dropped.  A shard holds numbers, not texts; a row is dealt by its place in the table of those numbers,
    so equal rows in any number fill no shard.

    Null or empty texts have no words and take a place of size 0.  A null source is a source; ids may be null or repeated
    (repeated rows have equal texts and so do not share a bin).  An empty table gives no rows; other columns are not read.
    """
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    # White space is folded before it is trimmed: texts that differ by a final newline are equal.
    norm = F.translate(F.btrim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+", " ")), UPPER, LOWER)
    items = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(norm).alias("cluster"), words.alias("w")))
    full = items.withColumn("k", F.floor(F.col("w") / capacity)).where("k > 0").select("doc_id", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("piece"))
    size = F.lit(capacity).cast("long")
    full = full.select((-1 - F.monotonically_increasing_id()).alias("bin_id"), "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("first_word"), size.alias("n_words"), size.alias("bin_words"))
    rest = items.where(f"w = 0 or w % {capacity} > 0").withColumn("piece", F.floor(F.col("w") / capacity)).withColumn("n_words", F.col("w") % capacity)
    shards = max(1, -(-rest.count() // shard_items))
    # The numbers lie in the checkpoint folder, so a row's place is the same however often a task runs.
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    rest = rest.select("shard", "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("first_word"), "n_words")
    kind_id, kind_source = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()

    def run(pdf):
        import numpy as np

        # Equal rows follow each other, so that the result does not depend on how rows arrive.
        pdf = pdf.sort_values(["n_words", "cluster", "doc_id", "source", "piece"], ascending=[False, True, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        src = pdf.source.astype(object).where(pdf.source.notna(), None)
        code: dict = {}
        sources = [code.setdefault(x, len(code)) for x in src]
        counts = pdf.cluster.value_counts()
        twice = {c: k for k, c in enumerate(sorted(counts[counts > 1].index))}
        bins = np.array(best_fit(pdf.n_words.tolist(), sources, [twice.get(c, -1) for c in pdf.cluster], capacity, per_source), np.int64)
        pdf["bin_words"] = np.bincount(bins, pdf.n_words.to_numpy()).astype(np.int64)[bins] if len(pdf) else 0
        pdf["bin_id"] = pdf.shard.astype("int64") * (1 << 32) + bins
        return pdf[["bin_id", "doc_id", "source", "cluster", "piece", "first_word", "n_words", "bin_words"]]

    schema = f"bin_id bigint, doc_id {kind_id}, source {kind_source}, cluster bigint, piece bigint, first_word bigint, n_words bigint, bin_words bigint"
    return rest.groupBy("shard").applyInPandas(run, schema).unionByName(full)
