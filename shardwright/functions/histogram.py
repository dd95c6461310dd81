"""A histogram of 154 fixed buckets with exact moments, and percentiles by interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEPS = [10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90]
#: Upper bounds: units below ten, then sixteen steps a decade, and one that is beyond all.
LIMITS = [float(i) for i in range(1, 10)] + [float(s * 10**k) for k in range(9) for s in _STEPS] + [1e200]


def bucket(value):
    """The bucket's number: how many bounds but the last are at or below the value, as a balanced tree of comparisons."""

    def between(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < LIMITS[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(LIMITS) - 1)


def bucket_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., bucket, n, total, squares, lo, hi): one row for each bucket that has values; merging is adding rows up."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*(by or []), v.alias("__v"))
    return rows.withColumn("bucket", bucket(F.col("__v"))).groupBy(*(by or []), "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__v").alias("total"), F.sum(F.col("__v") * F.col("__v")).alias("squares"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
    )


def stats(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., count, min, max, average, stddev): population standard deviation."""
    n, s, q = F.sum("n"), F.sum("total"), F.sum("squares")
    agg = (n.alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max"), (s / n).alias("average"), F.sqrt(F.greatest((q * n - s * s) / (n * n), F.lit(0.0))).alias("stddev"))
    return counts.groupBy(*(by or [])).agg(*agg)


def percentiles(counts: DataFrame, ps: list[float]) -> DataFrame:
    """(p, value): linear inside the bucket where the truncated rank n * p / 100 is reached, over n + 1, kept in [min, max].

    The window runs over at most 154 rows, one for each bucket."""
    total = counts.agg(F.sum("n").alias("all_n"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    p = upto.join(F.broadcast(total)).withColumn("p", F.explode(F.array(*(F.lit(float(x)) for x in ps))))
    rank = F.floor(F.col("all_n") * (F.col("p") / 100.0))
    low = F.array(F.lit(0.0), *map(F.lit, LIMITS))
    here = p.withColumn("rank", rank).where("upto >= rank").withColumn("first", F.row_number().over(Window.partitionBy("p").orderBy("bucket"))).where("first = 1")
    lo, hi = F.get(low, F.col("bucket")), F.get(low, F.col("bucket") + 1)
    pos = (F.col("rank") - (F.col("upto") - F.col("n"))) / (F.col("n") + 1)
    return here.select("p", F.greatest(F.col("least"), F.least(F.col("most"), lo + (hi - lo) * pos)).alias("value"))
