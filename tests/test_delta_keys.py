"""No order key is merged with another by the bits of a delta code."""

from shardwright.functions import maths
from shardwright.queries import QUERIES


def test_every_key_comes_back(spark, tmp_path):
    rows = [(1, 5), (1, 60005), (1, 65541), (1, 6), (1, 32767), (1, 32768), (2, 3_000_000_000), (2, 0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(r.o_custkey, r.high << 15 | k) for r in QUERIES["delta_encode"](spark, str(tmp_path)).collect() for k in maths.undelta16(list(r.code))]
    assert sorted(got) == sorted(rows)
