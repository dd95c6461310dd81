"""Counters over sliding time windows, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_sums(df: DataFrame, ts: str, keys: list[str], bins: int, precision: int, amount: str | None = None) -> DataFrame:
    """(keys..., bin, n, total): events of each bin of `precision` seconds, and the sum of the last `bins` bins up to it.

    Bins are summed first; the window runs over bins, of which a key has no more than time has."""
    bin_at = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (precision * 1_000_000)) * precision).cast("bigint")
    n = F.sum(amount) if amount else F.count(F.lit(1))
    binned = df.groupBy(*keys, bin_at.alias("bin")).agg(n.cast("bigint").alias("n"))
    last = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-(bins - 1) * precision, 0)
    return binned.withColumn("total", F.sum("n").over(last))


def rate(df: DataFrame, ts: str, keys: list[str], seconds: int = 9) -> DataFrame:
    """(keys..., bin, qps): for each second with events, the mean of the `seconds` complete seconds before it, as a whole number."""
    bin_at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("bigint")
    binned = df.groupBy(*keys, bin_at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-seconds, -1)
    return binned.select(*keys, "bin", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / seconds).cast("bigint").alias("qps"))


def averages(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(start, keys..., count, total, average) of sliding windows; on a stream, set a watermark first."""
    w = df.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count(value).alias("count"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), *keys, "count", "total", (F.col("total") / F.col("count")).alias("average"))


def stream_counts(stream: DataFrame, ts: str, keys: list[str], bins: int, precision: int, late: str = "1 minute") -> DataFrame:
    """The sliding sums of a stream: windows of bins * precision seconds that move by precision, events later than `late` dropped."""
    w = F.window(ts, f"{bins * precision} seconds", f"{precision} seconds")
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("total")).select(F.col("w.end").alias("end"), *keys, "total")
