"""Connected components of a graph given as a DataFrame of edges, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b: comparable, of one type) to (node, root), root being the smallest node of the component.

    Alternates the two star operations: every node hangs its larger neighbours (large star), then itself and its
    smaller neighbours (small star), on the smallest node it knows.  The rounds needed grow with the logarithm of the
    component's size, each is a few equi-joins that AQE can split where one node has many edges, and no
    neighbour list is ever collected.  Self loops and null ends are ignored; no edges give no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(low, both.a == low.u).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = large.join(low, large.a == low.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(hung.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    """A count and an order-free checksum of the edges: equal states mean that a round changed nothing."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
