"""Pipelines of typed tables: readers, maps, shards, joins, sinks, counters and frequency maps over DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..sources import files, lst
from . import sharding
from .cogroup import ShardHandler, join_shards, placed_rows


class PipelineError(ValueError):
    """A plan that can't run; raised when it is made, not when it runs."""


class Table:
    """A lazy collection of records of one type, with its place in a pipeline."""

    def __init__(self, pipeline: Pipeline, name: str, df: DataFrame, identity: bool = False, shard: str | None = None, n_shards: int | None = None, sources: Iterable[str] = ()):
        self.pipeline, self.name, self.df, self.sources = pipeline, name, df, tuple(dict.fromkeys(sources))
        self.identity, self.shard, self.n_shards = identity, shard, n_shards
        self.written: str | None = None
        self.observation: Observation | None = None

    def map(self, name: str, fn: Callable | list[Column], schema: str | None = None, args: tuple = ()) -> Table:
        """A new table by column expressions, a function of DataFrames, or (with schema) a generator over records.

        A generator gets a dict (and args) and yields tuples; fn may be a class, made with args, with do(record) and finish(), the
        latter called at the end of each task's input.  Prefer expressions: they stay in compiled code.
        """
        if isinstance(fn, list):
            df = self.df.select(*fn)
        elif schema is None:
            df = fn(self.df)
        else:
            df = self.df.mapInArrow(functools.partial(_map_records, fn, args, _parse_datatype_string(schema), False), schema)
        return Table(self.pipeline, name, df, shard=self.shard if self.shard in df.columns else None, n_shards=self.n_shards, sources=self.sources)

    def route(self, name: str, fn: Callable, schema: str, args: tuple = ()) -> Table:
        """map() by a generator or class that yields to_shard(name of a shard, ...): a table with named shards.

        Records that it yields without a shard stay in the shard "rest".
        """
        full = f"{schema}, shard string"
        df = self.df.mapInArrow(functools.partial(_map_records, fn, args, _parse_datatype_string(full), True), full)
        return Table(self.pipeline, name, df, shard="shard", sources=self.sources)

    def as_json(self, schema: str | None = None) -> Table:
        """Records of a read table parsed as JSON into a column json; bad records are dropped and counted as parse-errors."""
        return self._parsed(lambda df: files.parse_json(df, schema), F.col("json").isNotNull())

    def as_type(self, decode: Callable[[Column], Column]) -> Table:
        """Records of a read table decoded into a column `record`; where the codec gives null the record is dropped and counted."""
        return self._parsed(lambda df: df.withColumn("record", decode(F.col("value"))), F.col("record").isNotNull())

    def _parsed(self, parse: Callable[[DataFrame], DataFrame], good: Column) -> Table:
        if not self.identity:
            raise PipelineError(f"{self.name}: only a table as it was read can be given another type")
        seen = Observation(f"{self.name}-{len(self.pipeline.observations)}")
        self.pipeline.observations.append((self.name, seen))
        df = parse(self.df).observe(seen, F.count(F.lit(1)).alias("fn-calls"), F.count_if(~good).alias("parse-errors")).where(good)
        return Table(self.pipeline, self.name, df, identity=False, sources=self.sources)

    def with_mod_n(self, n: int, value: Column) -> Table:
        """Numbered shards: value (as unsigned 32 bits) modulo n."""
        return Table(self.pipeline, self.name, sharding.with_mod_shard(self.df, value, n), shard="shard", n_shards=n, sources=self.sources)

    def with_custom(self, name: Column) -> Table:
        """Named shards; a name may hold slashes and then is a path."""
        return Table(self.pipeline, self.name, self.df.withColumn("shard", name.cast("string")), shard="shard", sources=self.sources)

    def bind(self, method: str) -> tuple[Table, str]:
        """This table as input of a join, whose records go to a handler's method."""
        return self, method

    def write(self, name: str, fmt: str = "txt", compression: str | None = None, value: str = "value", max_records: int = 0, max_bytes: int = 0, level: int | None = None, pieces: int = 1) -> Table:
        """Plan the sink <root>/<name>/, once for each table; it is written by Pipeline.run() and then is an input of that name.

        Files: <name>-shard-0000.txt for numbered shards, <shard>.txt for named ones; with more than one file in a
        shard, -000, -001, ... before the extension.  fmt txt (compression gzip or zstd) or lst; a file ends after
        max_records records or max_bytes bytes before compression; pieces: tasks that share a hot shard.
        """
        if self.shard is None:
            raise PipelineError(f"{self.name}: no sharding was given")
        if self.written or name in self.pipeline.sinks:
            raise PipelineError(f"{name}: written already")
        if fmt not in ("txt", "lst") or (fmt == "lst" and compression):
            raise PipelineError(f"{name}: {fmt} with compression {compression}")
        self.written = name
        self.pipeline.sinks[name] = (self, fmt, compression, value, {"max_records": max_records, "max_bytes": max_bytes, "level": level, "pieces": pieces})
        return self


def _map_records(fn, args, kind, routed, batches):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    h = fn(*args) if isinstance(fn, type) else None
    do, arrow = (h.do if h else (lambda r: fn(r, *args))), to_arrow_schema(kind)

    def batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], arrow)

    def rows_of(found):
        return placed_rows(found, "rest") if routed else list(found or ())

    for b in batches:
        rows = [r for rec in b.to_pylist() for r in rows_of(do(rec))]
        if rows:
            yield batch(rows)
    if h and hasattr(h, "finish") and (rows := rows_of(h.finish())):
        yield batch(rows)


class _Sums(AccumulatorParam):
    """Sums by name."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


class UserCounter:
    """Counters that mappers and handlers increment by name; give it to them in args.

    Counts come from the tasks that end well; those of a task that runs again after its executor was lost count again.
    """

    def __init__(self, sums):
        self.sums = sums

    def add(self, name: str, n: int = 1) -> None:
        self.sums.add({name: n})


def _metrics(seen: Observation, seconds: float = 20) -> dict:
    """What an observation saw; empty where the plan that ran left it out, for which get() would wait for ever."""
    import threading

    found: dict = {}
    t = threading.Thread(target=lambda: found.update(seen.get), daemon=True)
    t.start()
    t.join(seconds)
    return dict(found)


class Pipeline:
    """Tables and sinks under one root folder; sinks are written in the order in which they were planned."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.inputs: dict[str, Table] = {}
        self.sinks: dict[str, tuple] = {}
        self.files: dict[str, list[tuple[str, str]]] = {}
        self.counters: dict[str, dict[str, int]] = {}
        self.observations: list[tuple[str, Observation]] = []
        self.freq: dict[str, DataFrame] = {}
        self.read_counts: dict[str, Observation] = {}
        self._sums = spark.sparkContext.accumulator({}, _Sums())
        self.counter = UserCounter(self._sums)
        self.stopped = False

    def read_text(self, name: str, inputs, skip_header: int = 0, with_position: bool = False) -> Table:
        return self._input(name, files.read_text(self.spark, inputs, skip_header, with_position))

    def read_lst(self, name: str, paths, **options) -> Table:
        return self._input(name, lst.read_lst(self.spark, paths, **options).withColumnRenamed("record", "value"))

    def read(self, name: str, df: DataFrame) -> Table:
        """Any DataFrame as an input: Parquet, JDBC, a stream's batch."""
        return self._input(name, df)

    def _input(self, name: str, df: DataFrame) -> Table:
        if name in self.inputs:
            raise PipelineError(f"{name}: an input of this name exists")
        self.read_counts[name] = Observation(f"map-input-{name}-{id(self)}")
        df = df.observe(self.read_counts[name], F.count(F.lit(1)).alias("n"))
        self.inputs[name] = Table(self, name, df, identity=True, sources=[name])
        return self.inputs[name]

    def join(self, name: str, bound: Iterable[tuple[Table, str]], handler: Callable[..., ShardHandler], schema: str, args: tuple = (), named: bool = False) -> Table:
        """Tables of equal numbers of shards joined shard by shard, in the order given, by handler(*args).

        The result keeps the shards, but for records that the handler sends elsewhere (to_shard); with `named` it has named shards.
        """
        bound = list(bound)
        counts = {t.n_shards for t, _ in bound}
        if None in counts or len(counts) != 1:
            raise PipelineError(f"{name}: inputs need numbered shards, of the same number")
        n = counts.pop()
        df = join_shards([(t.df, m) for t, m in bound], functools.partial(handler, *args), n, schema, named=named)
        return Table(self, name, df, shard="shard", n_shards=None if named else n, sources=[s for t, _ in bound for s in t.sources])

    def freq_map(self, name: str, df: DataFrame, key: str, by: str | None = None) -> DataFrame:
        """A frequency map (key, n): counts, or sums of `by`, kept under a name that can be given once."""
        if name in self.freq:
            raise PipelineError(f"{name}: a frequency map of this name exists")
        self.freq[name] = df.groupBy(F.col(key).alias("key")).agg((F.sum(by) if by else F.count(F.lit(1))).cast("bigint").alias("n"))
        return self.freq[name]

    def find_freq_map(self, name: str) -> DataFrame:
        return self.freq[name]

    def freq_dict(self, name: str, most: int = 1_000_000) -> dict:
        """A frequency map of at most `most` keys as a dict, to be given to handlers in args; a larger one is an error and wants a join."""
        n = self.freq[name].count()
        if n > most:
            raise PipelineError(f"{name}: {n} keys are too many to send; join its table")
        return {r.key: r.n for r in self.freq[name].collect()}

    def stop(self) -> None:
        """Cancel what runs and skip the sinks that have not begun; run() then returns False."""
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(f"pipeline-{id(self)}")

    def run(self) -> bool:
        from . import sinks

        self.spark.sparkContext.setJobGroup(f"pipeline-{id(self)}", "pipeline", interruptOnCancel=True)
        for name, (table, fmt, compression, value, how) in self.sinks.items():
            if self.stopped:
                return False
            seen, known = Observation(f"write-{name}"), dict(self._sums.value)
            df = table.df.observe(seen, F.count(F.lit(1)).alias("fn-writes"))
            self.files[name] = sinks.write_shards(df, f"{self.root}/{name}", name, fmt, compression, value, table.shard, table.n_shards, **how)
            counts = _metrics(seen)
            for owner, o in self.observations:
                if owner == table.name:
                    counts |= _metrics(o)
            for source in table.sources:
                counts |= {f"map-input-{source}": n for n in _metrics(self.read_counts[source]).values()} if source in self.read_counts else {}
            counts |= {k: n - known.get(k, 0) for k, n in self._sums.value.items() if n != known.get(k, 0)}
            self.counters[name] = {k: int(v) for k, v in counts.items()}
            sinks.write_counters(self.spark, f"{self.root}/{name}/counter_map.csv", self.counters[name])
            self.inputs[name] = Table(self, name, table.df, identity=True, shard=table.shard, n_shards=table.n_shards)
        return True
