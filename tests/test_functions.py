"""Functions against known values and plain Python."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shardwright.functions import hashing, histogram, maths, text
from shardwright.operators import inspect, sharding
from shardwright.streaming import counters


def values(spark, kind, data, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(data)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("fn", "kind", "data", "want"),
    [
        (text.human_bytes, "long", [0, 12, 1023, 1024, 1536, -2048, 1 << 20, 5 << 30, 1 << 50, 7 << 60, 1 << 60], ["0B", "12B", "1023B", "1.0K", "1.5K", "-2.0K", "1.00M", "5.00G", "1.00P", "7.00E", "1.00E"]),
        (text.human_bytes_exact, "long", [0, 1000, 1024, 3 << 20, 1025, -(1 << 40)], ["0B", "1000B", "1K", "3M", "1025B", "-1T"]),
        (text.parse_human_bytes, "string", ["12", "1.5K", "2MB", "x", None, "-3G"], [12.0, 1536.0, 2.0 * (1 << 20), None, None, -3.0 * (1 << 30)]),
        (text.human_int, "long", [999, 1500, -2_000_000, 30135, 5 * 10**12, 145_625], ["999", "1.50k", "-2.00M", "30.14k", "5.00T", "145.62k"]),
        (text.parse_human_int, "string", ["1.5k", "7", "2M", "-1.5", "3x"], [1500, 7, 2_000_000, -2, None]),
        (text.elapsed, "double", [0.0005, 0.25, 1.5, 90.0, 7200.0, 3 * 86400.0, 60 * 86400.0, 800 * 86400.0, -3.0], ["500 us", "250 ms", "1.5 s", "1.5 min", "2 h", "3 days", "1.97 months", "2.19 years", "-3 s"]),
        (lambda c: text.to_base(c, 36), "long", [0, 35, 32022, -1], ["0", "Z", "OPI", "3W5E11264SGSF"]),
        (lambda c: text.to_base(c, 2), "long", [5, -1], ["101", "1" * 64]),
        (text.hex64, "long", [255, -1], ["00000000000000ff", "f" * 16]),
        (text.url_encode, "string", ["a b+c", "-_.!~*'()", "é%", ""], ["a%20b%2Bc", "-_.!~*'()", "%C3%A9%25", ""]),
        (lambda c: text.parse_int(c, "int"), "string", ["12", " -3 ", "3000000000", "1.0", "x", "", None, "+4"], [12, -3, None, None, None, None, None, 4]),
        (lambda c: text.parse_int_base(c, 16), "string", ["ff", "-10", "FFFFFFFFFFFFFFFFF", "xyz", "007"], [255, -16, None, None, 7]),
        (text.parse_double, "string", ["1.5", " 2e3 ", "1d", "x"], [1.5, 2000.0, None, None]),
        (lambda c: text.leading_int(c, 9), "string", ["12ab", "x", " -5 z", "99999999999999999999"], [12, 9, -5, 9]),
        (lambda c: text.leading_double(c, 9.0), "string", ["1.5ab", "x", ".5", "2e2z"], [1.5, 9.0, 0.5, 200.0]),
        (lambda c: text.leading_hex(c, 9), "string", ["0x1fz", "x", "ff"], [31, 9, 255]),
        (lambda c: text.parse_bool(c, False), "string", ["yes", "N", "1", "what"], [True, False, True, False]),
        (text.file_extension, "string", ["a/b.txt", "a.b/c", "x.tar.gz"], ["txt", "", "gz"]),
        (text.dir_name, "string", ["a/b/c", "c", "/c"], ["a/b", "", ""]),
        (text.lines, "string", ["a\r\nb\rc\n", "", "x"], [["a", "b\rc"], [], ["x"]]),
        (text.csv_fields, "string", ['a, b ,"c ""d"" , e"x,', "", '"",x', "1"], [["a", "b", 'c "d" , e', ""], [], ["", "x"], ["1"]]),
        (maths.log2_floor, "long", [0, 1, 2, 1023, 1 << 62, (1 << 63) - 1], [-1, 0, 1, 9, 62, 62]),
        (maths.lowest_bit, "long", [1, 8, 12, 1 << 40], [0, 3, 2, 40]),
        (maths.next_power_of_2, "long", [0, 1, 2, 3, 1000, 1024], [1, 1, 2, 4, 1024, 1024]),
        (maths.sign, "double", [-2.0, 0.0, 3.0, float("nan"), None], [-1, 0, 1, 0, None]),
        (maths.round_half_even, "double", [0.5, 1.5, 2.5, -0.5], [0, 2, 2, 0]),
        (maths.gaps, "array<long>", [[5, 7, 10], [], [3]], [[5, 2, 3], [], [3]]),
        (maths.delta_encode, "array<int>", [list(range(1, 10)), list(range(6)), [56, 58, 59, 60, 62, 64], [], None], [[1, 0, 13], [0, 9], [56, 1, 0, 0, 2, 2], [], None]),
        (lambda c: sharding.mod_n(c, 7), "long", [11, -1, 1 << 32, (1 << 32) + 5], [4, 4294967295 % 7, 0, 5]),
    ],
)
def test_values(spark, fn, kind, data, want):
    assert values(spark, kind, data, fn) == want


def test_delta_round_trip():
    r = random.Random(1)
    for _ in range(300):
        v = sorted(r.sample(range(r.choice([20, 300, 65536])), r.randint(1, 15)))
        assert maths.undelta16(maths.delta16(v)) == v


def test_hashes(spark):
    words = ["", "a", "hello", "Ünïcode", "x" * 100]
    want = [xxhash.xxh64_intdigest(w.encode(), 24061983) for w in words]
    assert [g % (1 << 64) for g in values(spark, "string", words, hashing.fingerprint)] == want
    assert values(spark, "string", words, hashing.fingerprint32) == [(w >> 32 ^ w) & 0xFFFFFFFF for w in want]
    assert values(spark, "string", ["", "hello", None], lambda c: hashing.murmur3_32(c, 0)) == [0, 0x248BFA47, None]
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert values(spark, "string", ["abc"], lambda c: hashing.xxh3_shard(c, 10)) == [xxhash.xxh3_64_intdigest(b"abc") % 10]


def test_vectors(spark):
    r = np.random.default_rng(1)
    a, b, m = r.normal(size=3), r.normal(size=3), r.normal(size=(3, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), m.tolist())], "a array<double>, b array<double>, m array<array<double>>")
    x, y, z = F.col("a"), F.col("b"), F.col("m")
    row = df.select(
        maths.dot(x, y).alias("dot"), maths.cross(x, y).alias("cross"), maths.angle(x, y).alias("angle"), maths.normalize(x).alias("unit"), maths.largest_abs_component(x).alias("big"),
        maths.det3(z).alias("det"), maths.inverse3(z).alias("inv"), maths.mat_vec3(z, x).alias("mv"), maths.mat_mul3(z, z).alias("mm"), maths.trace3(z).alias("tr"), maths.frobenius3(z).alias("fro"), maths.transpose3(z).alias("t"),
    ).first()
    near = lambda g, w: np.allclose(np.array(g), w)
    assert near(row.dot, a @ b) and near(row.cross, np.cross(a, b)) and near(row.unit, a / np.linalg.norm(a)) and row.big == np.abs(a).argmax()
    assert near(row.angle, math.acos(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
    assert near(row.det, np.linalg.det(m)) and near(row.inv, np.linalg.inv(m)) and near(row.mv, m @ a) and near(row.mm, m @ m) and near(row.tr, np.trace(m)) and near(row.fro, np.linalg.norm(m)) and near(row.t, m.T)


def test_histogram(spark):
    assert len(histogram.LIMITS) == 154
    r = random.Random(2)
    data = [r.choice([0.5, 1.0, 9.99, 10.0, 12.0, 1e9, 9e9, 1e12]) * r.choice([1, 1, 1, 0.3]) for _ in range(400)] + [10.0] * 100
    df = spark.createDataFrame([(x,) for x in data], "x double")
    counts = histogram.bucket_counts(df, "x")
    want = {}
    for x in data:
        k = sum(h <= x for h in histogram.LIMITS[:-1])
        want[k] = want.get(k, 0) + 1
    assert {c.bucket: c.n for c in counts.collect()} == want
    s = histogram.stats(counts).first()
    assert (s["count"], s["min"], s["max"]) == (500, min(data), max(data))
    assert s.average == pytest.approx(np.mean(data)) and s.stddev == pytest.approx(np.std(data))
    ten = histogram.bucket_counts(spark.createDataFrame([(10.0,)] * 100, "x double"), "x")
    assert histogram.stats(ten).first().average == 10
    assert {p.p: p.value for p in histogram.percentiles(ten, [1, 50]).collect()} == {1.0: 10.0, 50.0: 10.0}


def test_sliding_counters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (12, "a"), (31, "a"), (5, "b")], "s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.bin): (r.n, r.total) for r in counters.sliding_sums(df, "ts", ["k"], 3, 10).collect()}
    assert got == {("a", 0): (2, 2), ("a", 10): (1, 3), ("a", 30): (1, 2), ("b", 0): (1, 1)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "ab"[k % 2]) for k in range(0, 100, 3)]
    df = spark.createDataFrame(rows, "s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = counters.stream_counts(stream, "ts", ["k"], 3, 10).writeStream.outputMode("complete").format("memory").queryName("sliding").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, int(r.end.timestamp())): r.total for r in spark.table("sliding").collect()}
    want = {}
    for s, k in rows:
        for end in range(s // 10 * 10 + 10, s // 10 * 10 + 40, 10):
            want[k, end] = want.get((k, end), 0) + 1
    assert got == want


def test_inspection(spark):
    schema = "id long not null, name string, a1 struct<s1: string, s2: array<string>>, b array<struct<s1: string, s2: array<string>>>, n array<int>"
    df = spark.createDataFrame([(1, "x", ("ab", ["c", "de"]), [("f", ["g", "h"]), ("ii", [])], [7, 8]), (2, None, None, None, [])], schema)
    sizes = {r.path: r.bytes for r in inspect.field_sizes(df).collect()}
    assert sizes == {"id": 16, "name": 1, "a1": 5, "a1.s1": 2, "a1.s2": 3, "b": 5, "b.s1": 3, "b.s2": 2, "n": 8}
    lines = lambda *p, **o: sorted(r.line for r in inspect.csv_project(df, list(p), **o).collect())
    assert lines("id", "name") == ["1,x", "2,\\N"]
    assert lines("1", "n") == ["1,7", "1,8"]
    assert lines("b.s1", "b.s2") == ["f,g", "f,h"]
    assert lines("n", "a1.s2") == ["7,c", "7,de", "8,c", "8,de"]
    assert lines("id", "n", aggregate_repeated=True) == ['1,"7,8"', "2,\\N"]
    table = inspect.table_schema(df.schema)
    assert table[0] == {"name": "id", "type": "INTEGER", "mode": "REQUIRED"} and table[3]["mode"] == "REPEATED" and table[3]["fields"][1] == {"name": "s2", "type": "STRING", "mode": "REPEATED"}
    kept = {r.k for r in inspect.sample_by_key(spark.range(200).select(F.col("id").cast("string").alias("k")), "k", 7).collect()}
    assert kept == {str(k) for k in range(200) if (hashing.fingerprint_of(str(k).encode()) & 0xFFFFFFFF) % 7 == 0}


def test_coders_and_tuple_hashes(spark):
    import struct

    import xxhash

    from shardwright.functions import hashing, maths, text
    from shardwright.sources.lst import read_varint
    from shardwright.sources.lst import varint as plain

    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**53 + 1]
    df = spark.createDataFrame([(n, f"s{n}", None if n == 1 else 1.5) for n in numbers], "n long, s string, d double")
    got = df.select("n", maths.varint(F.col("n")).alias("v"), maths.fixed64(F.col("n")).alias("f"), maths.unzigzag(maths.zigzag(-F.col("n"))).alias("z"), hashing.xxh64_of(F.col("n"), F.col("s")).alias("h"), hashing.xxh64_of(F.col("n"), F.col("d")).alias("g")).collect()
    for r in got:
        assert bytes(r.v) == plain(r.n) and bytes(r.f) == struct.pack("<q", r.n) and r.z == -r.n
        assert r.n >= 1 << 28 or read_varint(bytes(r.v), 0)[0] == r.n
        want = xxhash.xxh64_intdigest(f"s{r.n}".encode(), xxhash.xxh64_intdigest(struct.pack("<q", r.n), hashing.FINGERPRINT_SEED))
        assert r.h == want - (1 << 64 if want >> 63 else 0) and (r.g is None) == (r.n == 1)
    texts = ["017x", "0x1Fz", "-08", "12", " -9", "", "x", "99999999999999999999", "4294967296", "+5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.leading_number(F.col("t"), 77, octal=True).alias("o"), text.leading_number(F.col("t"), 77).alias("d"), text.leading_number(F.col("t"), 77, bits=32, signed=False).alias("u"), text.parse_uint(F.col("t"), 64).alias("w")).collect()
    assert [r.o for r in rows] == [15, 31, 0, 12, -9, 77, 77, 77, 4294967296, 5]
    assert [r.d for r in rows] == [17, 0, -8, 12, -9, 77, 77, 77, 4294967296, 5]
    assert [r.u for r in rows] == [17, 0, 77, 12, 77, 77, 77, 77, 77, 5]
    assert [r.w and int(r.w) for r in rows] == [None, None, None, 12, None, None, None, None, 4294967296, 5]


def test_rotations_and_components(spark):
    from shardwright.functions import maths

    df = spark.createDataFrame([([0.0, 0.0, 1.5707963267948966], [[2.0, 0.0, 1.0], [0.0, 3.0, 0.0], [1.0, 0.0, 1.0]], [3.0, -1.0, 2.5])], "v array<double>, m array<array<double>>, u array<double>")
    m, v, u = F.col("m"), F.col("v"), F.col("u")
    r = df.select(
        maths.mat_vec3(maths.rotation3(v), F.array(*map(F.lit, (1.0, 0.0, 0.0)))).alias("turned"), maths.mat_mul3(m, maths.adjugate3(m)).alias("det_one"), maths.det3(m).alias("det"), maths.component_order(u).alias("order"),
        maths.dot(maths.unit_orthogonal(u), u).alias("right"), maths.norm(maths.unit_orthogonal(u)).alias("one"), maths.mat_vec3(maths.cross_matrix3(u), v).alias("crossed"), maths.cross(u, v).alias("cross"), maths.between3(u, m, v).alias("b"),
        maths.col3(m, 2).alias("col"), maths.from_cols3(u, u, u)[1].alias("rows"), maths.any_nan(u).alias("nan"), maths.vectors_almost_equal(u, u, 1e-9).alias("same"), maths.each(u, "rint").alias("rint"), maths.each(u, "iround").alias("iround"),
    ).first()
    assert [round(x, 9) for x in r.turned] == [0, 1, 0] and r.order == [1, 2, 0] and abs(r.right) < 1e-12 and abs(r.one - 1) < 1e-12
    assert r.det_one == [[r.det if i == j else 0 for j in range(3)] for i in range(3)] and r.crossed == r.cross
    assert r.b == 1.5707963267948966 * (3.0 + 2.5) and r.col == [1.0, 0.0, 1.0] and r.rows == [-1.0] * 3 and not r.nan and r.same
    assert r.rint == [3.0, -1.0, 2.0] and r.iround == [3, -1, 3]
