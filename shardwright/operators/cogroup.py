"""Handlers that see one shard after the other, and in it one input after the other."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .spool import records, together


class Routed(NamedTuple):
    """A record that its maker sends to a shard of its own choice."""

    shard: int | str
    values: tuple


def to_shard(shard: int | str, *values) -> Routed:
    """What a handler or mapper yields to send a record to a shard other than the one that it works on."""
    return Routed(shard, values)


def placed_rows(found, shard):
    """Yielded records as tuples that end with their shard."""
    return [(*x.values, x.shard) if isinstance(x, Routed) else (*x, shard) for x in found or ()]


class ShardHandler:
    """State and methods of one joiner.  start(shard) and finish() may yield records, as may the bound methods.

    One handler serves all shards that a task gets, so finish() has to clear what start() does not.
    """

    def start(self, shard: int) -> Iterator:
        return iter(())

    def finish(self) -> Iterator:
        return iter(())


def join_shards(inputs: list[tuple[DataFrame, str]], handler: Callable[[], ShardHandler], n_shards: int, schema: str, shard: str = "shard", named: bool = False) -> DataFrame:
    """N inputs (DataFrame with an int column `shard`, name of the handler's method) joined shard by shard.

    All records of input 0 go to its method, then those of input 1, and so on; then finish() is called.  Methods get a
    dict and yield tuples of `schema`, or to_shard(shard, ...) to send a record elsewhere; the result also has the shard: a
    number, or with `named` the name that each record was sent to.  Records stream by Arrow batches; those of later inputs
    wait on the task's disk, so a shard is never collected; what a handler keeps is its own matter.  For joins and counts by key
    use DataFrame joins and groupBy, which spill and combine; this is for logic that has no such form.
    """
    tagged = []
    for k, (df, _) in enumerate(inputs):
        if shard not in df.columns:
            raise ValueError(f"input {k} has no column {shard}: it was not sharded")
        cols = [c for c in df.columns if c != shard]
        tagged.append(df.select(F.col(shard).cast("int").alias("__shard"), F.lit(k).alias("__input"), F.struct(*cols).alias(f"__r{k}")))
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    placed = union.repartitionById(n_shards, F.col("__shard"))
    methods = [m for _, m in inputs]
    kind = _parse_datatype_string(f"{schema}, {shard} {'string' if named else 'int'}")

    def run(batches):
        import itertools

        import pyarrow as pa

        unset = object()
        h, now = handler(), unset
        arrow = to_arrow_schema(kind)

        def own(s):
            return f"{s:04d}" if named else s

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        def made(found, s):
            found = iter(found or ())
            while rows := placed_rows(itertools.islice(found, 10_000), own(s)):
                yield batch(rows)

        for (s, k), part in together(batches, "__shard", "__input"):
            if s != now:
                if now is not unset:
                    yield from made(h.finish(), now)
                now = s
                yield from made(h.start(s), s)
            do = getattr(h, methods[k])
            yield from made((x for r in records(part.column(part.schema.get_field_index(f"__r{k}"))) for x in do(r) or ()), s)
        if now is not unset:
            yield from made(h.finish(), now)

    return placed.mapInArrow(run, kind)
