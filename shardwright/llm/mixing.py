"""Mixing sources to target weights by temperature, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Sources whose plan may be sent whole to every executor; counted before it is.
BROADCAST_SOURCES = 100_000


def _at(shares: DataFrame, alphas: list[float], total: float) -> list:
    """For each exponent: (alpha, entropy of the weights p^alpha / sum, largest number of passes over a source where every source is passed once at least)."""
    p = F.col("tokens") / F.lit(total)
    z = shares.select(F.explode(F.array(*map(F.lit, alphas))).alias("alpha"), p.alias("p")).groupBy("alpha")
    # With w = p^a / z: entropy = ln z - a * sum(p^a ln p) / z.  Passes r = B * w / (p T), and min r = 1 makes max r the ratio of the extremes of p^(a-1).
    z = z.agg(F.sum(F.pow("p", "alpha")).alias("z"), F.sum(F.pow("p", "alpha") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("alpha") - 1)).alias("most"), F.min(F.pow("p", F.col("alpha") - 1)).alias("least"))
    return z.select("alpha", (F.log("z") - F.col("alpha") * F.col("s") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("passes")).orderBy("alpha").collect()


def exponent(totals: DataFrame, target_entropy: float, max_passes: float, ways: int = 33, rounds: int = 5) -> float:
    """The smallest-change exponent in [0, 1]: entropy of at least target_entropy * ln(sources), and no source passed more often than max_passes.

    Both fall as the exponent grows, so each is bisected, many ways at a time: one aggregation of the source table
    tests `ways` exponents at once.  Where both can't hold, the limit on passes rules.
    """
    t = totals.where("tokens > 0")
    total, n = t.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    import math

    aim = target_entropy * math.log(n)

    def last(good) -> float:
        """The bound between exponents that pass `good` (below) and those that don't."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * k / (ways - 1) for k in range(ways)]
            ok = [good(r) for r in _at(t, grid, float(total))]
            if all(ok):
                return grid[-1]
            if not ok[0]:
                return grid[0]
            k = max(i for i in range(ways) if all(ok[: i + 1]))
            lo, hi = grid[k], grid[k + 1]
        return lo

    by_entropy = last(lambda r: r.entropy >= aim)
    by_passes = last(lambda r: r.passes > max_passes)  # below the bound there are too many passes
    if _at(t, [by_passes], float(total))[0].passes > max_passes * (1 + 1e-12):
        by_passes += 1.0 / (ways - 1) ** rounds
    return min(1.0, max(by_entropy, by_passes))


def plan_mixture(docs: DataFrame, target_entropy: float = 0.98, max_passes: float = 2.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens, docs, weight, passes, full, hash_limit): what each source gives.

    weight is its share of the mixture; the budget is the least that passes every source once, so no document is lost;
    passes = budget * weight / tokens, of which `full` are whole.  The rest of the budget is the start of one more
    permutation, cut where its documents' words reach it: words are summed by block of the hash first, and only in the one
    block where the budget ends are documents ordered.  There are about as many blocks as documents in a block.
    hash_limit is the last place (_order) that is inside (null: none).  Texts are read once, for their words.
    """
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(source_col).alias("source"), _order(seed, id_col).alias("u"), words.alias("w")))
    totals = cut(sized.groupBy("source").agg(F.sum("w").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    a = exponent(totals, target_entropy, max_passes)
    total, n = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    p = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(max(total, 1))))
    raw = totals.withColumn("raw", F.pow(p, F.lit(a))).withColumn("r", F.pow(p, F.lit(a - 1)))
    z = raw.agg(F.sum("raw"), F.min("r")).first()
    zsum, rmin = float(z[0] or 1), float(z[1] or 1)
    plan = raw.select("source", "tokens", "docs", F.coalesce(F.col("raw") / F.lit(zsum), F.lit(0.0)).alias("weight"), F.least(F.coalesce(F.round(F.col("r") / F.lit(rmin), 9), F.lit(1.0)), F.lit(float(max_passes))).alias("passes"))
    plan = cut(plan.withColumn("full", F.floor("passes").cast("int")).withColumn("rest", F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).cast("long")))
    bits = max(12, int(n).bit_length() // 2)
    sized = _meet(sized.withColumnRenamed("source", "__source"), plan.where("rest > 0").select("source", "rest")).withColumn("block", F.shiftrightunsigned("u", 63 - bits))
    by_block = sized.groupBy("source", "block").agg(F.sum("w").alias("w"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_block.withColumn("upto", F.sum("w").over(run)).where("upto >= rest")
    ends = cut(ends.groupBy("source").agg(F.min("block").alias("cut_block"), F.min(F.col("upto")).alias("upto"), F.min_by("w", "block").alias("w"), F.first("rest").alias("rest")).select("source", "cut_block", (F.col("rest") - F.col("upto") + F.col("w")).alias("room")))
    inside = _meet(sized.select(F.col("source").alias("__source"), "block", "u", "w"), ends).where("block = cut_block").groupBy("source", "u").agg(F.sum("w").alias("w"), F.first("room").alias("room"))
    run = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    limit = inside.withColumn("upto", F.sum("w").over(run)).where("upto <= room").groupBy(F.col("source").alias("s2")).agg(F.max("u").alias("last"))
    # No document of the block fits: what lies before the block is inside.
    e = ends.withColumnRenamed("source", "s").join(limit, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("last", F.shiftleft("cut_block", 63 - bits) - 1).alias("hash_limit"))
    return cut(plan.join(e, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", "docs", "weight", "passes", "full", "hash_limit"))


def _order(seed: int, id_col: str):
    """The place of a row in its source's permutation: a hash of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)


def _meet(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows (with __source) joined to a table with one row for each source; that table is broadcast only if it was counted to be small."""
    small = by_source.count() <= BROADCAST_SOURCES
    own = by_source.withColumnRenamed("source", "__key")
    own = F.broadcast(own) if small else own
    return rows.join(own, F.col("__source").eqNullSafe(F.col("__key"))).withColumnRenamed("__source", "source").drop("__key")


def mix_sources(docs: DataFrame, target_entropy: float = 0.98, max_passes: float = 2.0, seed: int = 0, mix_blocks: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs, each once for every pass that its source's budget holds, all columns kept, with __copy, __mix_block and __mix_order added.

    Every source is a chain of permutations (by hash of id, another seed for each pass) of its documents, cut at its
    token budget (plan_mixture).  Chains are laid side by side and cut into `mix_blocks` blocks that each hold the
    sources at the target weights; sorting by (__mix_block, __mix_order) gives the training order.  A text is read and
    written, never shuffled.  Every document comes at least once and at most ceil(max_passes) times.

    Rows repeating an id share their place in the permutation: all of them or none are inside a budget.  Null ids are
    rows repeating an id.  A null source is a source, a null text has no words; sources without words pass once.  An empty
    table gives no rows.  Columns of docs that bear the names of the added ones are replaced.
    """
    docs = docs.drop("__copy", "__mix_block", "__mix_order")
    plan = plan_mixture(docs, target_entropy, max_passes, seed, id_col, source_col, text_col)
    names = [F.col(f"`{c}`") for c in docs.columns]
    part = plan.select("source", F.col("passes").alias("__passes"), F.col("full").alias("__full"), F.col("hash_limit").alias("__limit"))
    rows = _meet(docs.select(F.struct(*names).alias("__row"), F.col(source_col).alias("__source"), _order(seed, id_col).alias("__u")), part)
    more = F.coalesce(F.col("__u") <= F.col("__limit"), F.lit(False))
    # The cut permutation comes last, under the hash of `seed`; whole passes are ordered by hashes of their own.
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__full") - 1 + more.cast("int"))))
    own = F.when(F.col("__copy") == F.col("__full"), F.col("__u")).otherwise(F.shiftrightunsigned(F.xxhash64("__u", "__copy"), 1)) / F.lit(float(1 << 63))
    place = (F.col("__copy") + own) / F.col("__passes")
    return rows.select("__row.*", "__copy", F.least(F.floor(place * mix_blocks), F.lit(mix_blocks - 1)).cast("int").alias("__mix_block"), F.xxhash64("__u", "__copy", F.lit("order")).alias("__mix_order"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, mix_block, mix_order of every document in the mixture."""
    m = mix_sources(docs.select("doc_id", "source", "text"))
    return m.select("doc_id", "source", F.col("__copy").alias("copy"), F.col("__mix_block").alias("mix_block"), F.col("__mix_order").alias("mix_order"))
