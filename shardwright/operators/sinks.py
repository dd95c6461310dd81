"""Sharded files with the names that readers expect, on any file system that Spark writes to."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spool import together, values

#: Files that a task of Spark's own writer has open at once; only where its rows have more names are they sorted first.
OPEN_FILES = 100


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: without one it lies in the cluster's own file system, not on the executors' disks."""
    fs, jpath = _fs(spark, path)
    return fs.makeQualified(jpath(path)).toString()


def write_shards(
    df: DataFrame, path: str, table: str, fmt: str = "txt", compression: str | None = None, value: str = "value", shard: str = "shard", n_shards: int | None = None, max_records: int = 0, max_bytes: int = 0, level: int | None = None, pieces: int = 1
) -> list[tuple[str, str]]:
    """Write df by shard and return the manifest [(shard, file)].

    Rows of a shard are brought to one task, or to as many as `pieces` says where shards are hot, and written with task
    commits, then the files get their names.  txt: value and a line feed (compression gzip or zstd, with a level); lst: LST1.
    A file ends after `max_records` records, or when `max_bytes` bytes before compression have been written to it.
    Plain and gzip text without a limit of bytes or a level goes through Spark's own writer.
    """
    spark = df.sparkSession
    ext = {"txt": ".txt" + {None: "", "gzip": ".gz", "zstd": ".zst"}[compression], "lst": ".lst"}[fmt]
    name = F.format_string(f"{table}-shard-%04d", F.col(shard)) if n_shards else F.col(shard)
    piece = F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), F.lit(pieces))
    if n_shards:  # every shard has tasks of its own
        at = F.pmod(F.col(shard).cast("bigint") * pieces + (piece if pieces > 1 else 0), F.lit(n_shards * pieces)).cast("int")
        rows = df.select(name.alias("__name"), F.col(value), at.alias("__at")).repartitionById(n_shards * pieces, F.col("__at")).drop("__at")
    else:
        # A stated number of partitions is kept as it is; without one, small partitions are merged again.
        rows, keys = df.select(name.alias("__name"), F.col(value)), ["__name"] if pieces == 1 else ["__name", piece]
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * pieces, *keys) if pieces > 1 else rows.repartition(*keys)
    fs, jpath = _fs(spark, path)
    if fs.exists(jpath(path)):
        raise ValueError(f"{path} exists")
    work = f"{path}/_work"
    if fmt == "txt" and compression != "zstd" and not max_bytes and level is None:
        text = rows.select("__name", F.col(value).cast("string").alias("value"))
        with _open_files(spark, OPEN_FILES):
            text.write.option("compression", compression or "none").option("maxRecordsPerFile", max_records).partitionBy("__name").text(work)
    else:
        write_framed(rows, qualified(spark, work), value, fmt, compression, max_records, max_bytes, level)
    out = []
    for folder in sorted(fs.listStatus(jpath(work)), key=lambda s: s.getPath().getName()) if fs.exists(jpath(work)) else ():
        if not folder.isDirectory():
            continue
        own = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().partition("=")[2])
        parts = sorted((f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-") and not f.getPath().getName().endswith(".tmp")), key=lambda p: p.getName())
        for k, part in enumerate(parts):
            target = f"{path}/{own}{f'-{k:03d}' if len(parts) > 1 else ''}{ext}"
            fs.mkdirs(jpath(target).getParent())
            if not fs.rename(part, jpath(target)):
                raise OSError(f"can't rename {part} to {target}")
            out.append((own, target))
    fs.delete(jpath(work), True)
    return out


@contextlib.contextmanager
def _open_files(spark: SparkSession, n: int):
    """Spark's writer keeps up to n files of a task open, instead of sorting the task's rows by name."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    had = spark.conf.get(key)
    spark.conf.set(key, str(max(n, int(had))))
    try:
        yield
    finally:
        spark.conf.set(key, had)


class _Part:
    """One file that is being written: an attempt's own name first, the final one when it is closed."""

    def __init__(self, fs, path: str, attempt: int, fmt: str, compression: str | None, level: int | None):
        import gzip

        import zstandard

        self.fs, self.path, self.tmp, self.fmt = fs, path, f"{path}.{attempt}.tmp", fmt
        self.raw = fs.open_output_stream(self.tmp, compression=None)
        if fmt == "lst":
            self.to = self.raw
        elif compression == "zstd":
            self.to = zstandard.ZstdCompressor(level=level or 1).stream_writer(self.raw, closefd=False)
        else:
            self.to = gzip.GzipFile(fileobj=self.raw, mode="wb", compresslevel=1 if level is None else level, mtime=0) if compression == "gzip" else self.raw

    def fill(self, records) -> None:
        """All records of an iterator, then the end of the file."""
        from ..sources.lst import encode

        for piece in encode(records) if self.fmt == "lst" else (v + b"\n" for v in records):
            self.to.write(piece)
        if self.to is not self.raw:
            self.to.close()
        self.raw.close()
        self.fs.move(self.tmp, self.path)


def write_framed(rows: DataFrame, work: str, value: str, fmt: str, compression: str | None = None, max_records: int = 0, max_bytes: int = 0, level: int | None = None) -> None:
    """Files that Spark has no writer for, or that end by raw size, in the file system that `work` (with a scheme) names.

    Every task writes <work>/__name=<shard>/part-<task>-<number>, first under the name of its attempt; an attempt that
    ends later replaces the same files.  Local, S3, GCS and HDFS paths are known; others are an error.  Rows of other
    shards than a task's first wait on its disk, so that a task holds a few batches whatever the size of its shards.
    """
    v = F.col(value) if rows.schema[value].dataType.typeName() == "binary" else F.col(value).cast("string").cast("binary")
    rows = rows.select("__name", v.alias("value"))

    def run(batches):
        import itertools
        import urllib.parse

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(work.replace("file:/", "file:///", 1) if work.startswith("file:/") and not work.startswith("file://") else work)
        task = TaskContext.get()
        done = []
        for name, group in itertools.groupby(together(batches, "__name"), key=lambda r: r[0][0]):
            folder = f"{root}/__name={urllib.parse.quote(str(name), safe='')}"
            fs.create_dir(folder, recursive=True)
            left = (v for _, b in group for v in values(b.column(1)) if v is not None)
            for k in itertools.count():
                first = next(left, None)
                if first is None:
                    break

                def some(first=first):
                    n, size, v = 0, 0, first
                    while v is not None:
                        yield v
                        n, size = n + 1, size + len(v) + (fmt == "txt")
                        if n == max_records or (max_bytes and size >= max_bytes):
                            return
                        v = next(left, None)

                path = f"{folder}/part-{task.partitionId():05d}-{k:05d}"
                _Part(fs, path, task.taskAttemptId(), fmt, compression, level).fill(some())
                done.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def write_counters(spark: SparkSession, path: str, counters: dict[str, int]) -> None:
    """A small CSV of counters, sorted by name."""
    fs, jpath = _fs(spark, path)
    out = fs.create(jpath(path), True)
    try:
        out.write(bytearray(("".join(f"{k},{v}\n" for k, v in [("counter", "value"), *sorted(counters.items())])).encode()))
    finally:
        out.close()
