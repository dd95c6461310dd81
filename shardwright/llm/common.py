"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workspace import is_local, shared_dir  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether the dataset has this table, asked of the path's own file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written, through the path's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def meet_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, how: str = "left", at_once: int = 10_000) -> DataFrame:
    """rows joined on `key` to table, which has one row for each key and in `size` the number of its rows (out of `total`).

    Keys of more than total / at_once rows are fewer than `at_once`; these travel to the rows by broadcast, so that no task
    gathers all rows of one key, and only the rows of other keys are shuffled.
    """
    most = max(10_000, total // at_once)
    hot = F.broadcast(table.where(F.col(size) > most).drop(size))
    names = [c for c in table.columns if c not in (key, size)]
    near = rows.join(hot, key, "inner")
    far = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(size) <= most).drop(size), key, how)
    return near.select(*rows.columns, *names).unionByName(far.select(*rows.columns, *names))


def ascii_lower(c):
    """Lower-case A-Z and nothing else.  Pure ASCII strings take the byte loop of lower(); others go through translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def in_pieces(batch, column: str, most_bytes: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """The values of a string column of an Arrow batch as UTF-8 bytes, in slices of a bounded size: (first row, values)."""
    import pyarrow as pa

    values, first, size = [], 0, 0
    for i, v in enumerate(batch.column(column).cast(pa.binary())):
        v = v.as_py() or b""
        if values and size + len(v) > most_bytes:
            yield first, values
            values, first, size = [], i, 0
        values.append(v)
        size += len(v)
    if values:
        yield first, values
