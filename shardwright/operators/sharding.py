"""Shards: physical placement of records by number or by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mod_n(value: Column, n: int) -> Column:
    """value modulo n, where the value counts as an unsigned 32-bit number: larger ones lose their upper half, negative ones wrap."""
    return F.pmod(value.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n)).cast("int")


def with_mod_shard(df: DataFrame, value: Column, n: int, column: str = "shard") -> DataFrame:
    return df.withColumn(column, mod_n(value, n))


def place(df: DataFrame, n: int, column: str = "shard") -> DataFrame:
    """Rows moved so that partition k holds shard k, for handlers and writers; joins by key need no such step."""
    return df.repartitionById(n, F.col(column))


def shard_name(table: str, shard: Column) -> Column:
    """<table>-shard-0007 for numbered shards; named shards are their own name."""
    return F.format_string(f"{table}-shard-%04d", shard)


def limit_per_task(df: DataFrame, n: int) -> DataFrame:
    """At most n rows of each task's input, for a look at a pipeline on little data; n = 0 is no limit. (A global limit is DataFrame.limit.)"""
    if not n:
        return df

    def run(batches):
        left = n
        for b in batches:
            if left <= 0:
                return
            yield b.slice(0, left)
            left -= b.num_rows

    return df.mapInArrow(run, df.schema)


def read_only(df: DataFrame) -> None:
    """Read and compute every row and keep nothing: the ceiling of a pipeline's input."""
    df.write.format("noop").mode("overwrite").save()
