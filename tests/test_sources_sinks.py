"""Files: LST records, text, CSV, JSON, sharded sinks, pipelines."""

import bz2
import datetime
import gzip
import os
import random
import re
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardwright.operators.cogroup import ShardHandler, join_shards, to_shard
from shardwright.operators.pipeline import Pipeline, PipelineError
from shardwright.sources import files, lst

SIZES = st.one_of(st.integers(0, 40), st.integers(65_500, 65_560), st.integers(0, 200_000))


@settings(max_examples=25, deadline=None)
@given(st.lists(SIZES, max_size=12), st.booleans(), st.sampled_from([1, 2]))
def test_lst_round_trip(sizes, compress, multiplier):
    r = random.Random(len(sizes))
    records = [r.randbytes(n) if k % 2 else b"ab" * (n // 2) for k, n in enumerate(sizes)]
    data = b"".join(lst.encode(records, {"k": b"v", "a": b""}, multiplier, compress))
    d = lst.Decoder(data, checksum=False)
    assert list(d.records()) == records and not d.dropped and d.meta == {"k": b"v", "a": b""}


def test_lst_small_and_many():
    records = [str(k).encode() for k in range(20_000)] + [b"", b"x" * 50_000, b"y" * 100_000]
    data = b"".join(lst.encode(records))
    assert list(lst.Decoder(data, checksum=False).records()) == records
    assert list(lst.Decoder(b"".join(lst.encode(records[:50]))).records()) == records[:50]


def test_lst_damage():
    records = [b"a" * 30_000, b"b" * 30_000, b"c" * 30_000, b"d" * 30_000]
    data = bytearray(b"".join(lst.encode(records)))
    data[7 + 9 + 500] ^= 1  # in the first block
    d = lst.Decoder(bytes(data))
    got = list(d.records())
    assert d.dropped and set(got) <= set(records) and records[3] in got
    cut = lst.Decoder(bytes(data[:-10]), checksum=False)
    list(cut.records())
    assert cut.dropped
    with pytest.raises(lst.LstError):
        lst.Decoder(b"nothing here")


def test_lz4_block():
    # literals "abc", then a match of 9 at distance 3, then literals "zz"
    assert lst.lz4_block(bytes([0x35]) + b"abc" + b"\x03\x00" + bytes([0x20]) + b"zz") == b"abcabcabcabc" + b"zz"


def test_lst_data_source(spark, tmp_path):
    lst.register(spark)
    df = spark.range(1000).select(F.encode(F.col("id").cast("string"), "utf-8").alias("record")).repartition(3)
    df.write.format("lst").option("meta.kind", "numbers").option("compression", "zlib").mode("append").save(str(tmp_path / "out"))
    names = [n for n in os.listdir(tmp_path / "out") if n.endswith(".lst")]
    assert len(names) == 3
    back = spark.read.format("lst").load(str(tmp_path / "out"))
    assert sorted(int(r.record) for r in back.collect()) == list(range(1000))
    other = lst.read_lst(spark, f"{tmp_path}/out/*.lst", skip=1)
    assert other.count() == 997 and other.agg(F.min("pos")).first()[0] == 0
    assert {(r.key, bytes(r.value)) for r in lst.lst_metadata(spark, f"{tmp_path}/out/*.lst").collect()} == {("kind", b"numbers")}


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    (tmp_path / "b.txt").write_bytes(b"head\nx\ny\n")
    got = files.read_text(spark, str(tmp_path / "a.txt"))
    assert [r.value for r in got.collect()] == ["one", "two\rstill two", "", "last"]
    specs = [files.FileSpec(str(tmp_path / "b.txt"), i64=42), files.FileSpec(str(tmp_path / "b.txt"), text="again"), str(tmp_path / "a.txt")]
    rows = files.read_text(spark, specs, skip_header=1, with_position=True).collect()
    assert len(rows) == 7
    assert {(r.value, r.meta.i64, r.meta.text, r.pos) for r in rows if r.value in ("x", "y")} == {("x", 42, None, 0), ("y", 42, None, 1), ("x", None, "again", 0), ("y", None, "again", 1)}


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, lambda b: gzip.compress(b[:3]) + gzip.compress(b[3:]), bz2.compress, zlib.compress, zstandard.ZstdCompressor().compress])
def test_compression_by_content(spark, tmp_path, pack):
    (tmp_path / "f.bin").write_bytes(pack(b"a\nb\r\nc"))
    assert [(r.value, r.pos) for r in files.read_any(spark, str(tmp_path / "f.bin")).collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_csv_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text('h1,h2\n a , "b ""q"", x"junk , c,\n\n  \n1,2\n""\n')
    got = [r.fields for r in files.read_csv(spark, str(tmp_path / "x.csv"), skip_header=1).collect()]
    assert got == [["a", 'b "q", x', "c", ""], ["1", "2"], [""]]
    assert files.read_csv(spark, str(tmp_path / "x.csv"), columns=2).count() == 2


def test_lenient_json(spark):
    rows = ['{"a": 1,}', '{"a": [1, 2, ], /* c */ "b": "x,}"}', '{"foo": null}', "nope", None, '{"u": "http://x"} // end']
    got = files.parse_json(spark.createDataFrame([(r,) for r in rows], "value string")).selectExpr("value", "to_json(json) as j").collect()
    assert [g.j for g in got] == ['{"a":1}', '{"a":[1,2],"b":"x,}"}', '{"foo":null}', None, None, '{"u":"http://x"}']
    has = spark.createDataFrame([(r,) for r in rows], "value string").select(files.json_has(F.col("value"), "foo").alias("x")).collect()
    assert [h.x for h in has] == [False, False, True, False, False, False]


def test_wet(spark):
    text = "WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nskip\nWARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://a/\r\n\r\nHéllo, ≠world\nline\n\nWARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: http://b/\n\nTwo"
    got = files.wet_pages(spark.createDataFrame([("f", text)], "file string, content string")).collect()
    assert [(g.uri, g.body) for g in got] == [("http://a/", "Héllo,  world\nline"), ("http://b/", "Two")]


# ---- pipelines


class Sum(ShardHandler):
    def start(self, shard):
        self.n = {}
        return iter(())

    def one(self, r):
        self.n[r["v"]] = self.n.get(r["v"], 0) + 1

    def ten(self, r):
        assert self.n is not None
        self.n[r["v"]] = self.n.get(r["v"], 0) + 10

    def finish(self):
        for k, v in sorted(self.n.items()):
            yield (f"{k}:{v}",)


def shards(path):
    out = {}
    for d, _, names in os.walk(path):
        for n in names:
            if not n.startswith((".", "counter_map", "_")):
                out[os.path.relpath(os.path.join(d, n), path)] = open(os.path.join(d, n), "rb").read()
    return out


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_pipeline_join_counters_and_names(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    a = p.read("s1", ints(spark, 1, 2, 3, 4)).with_mod_n(3, F.col("v"))
    b = p.read("s2", ints(spark, 2, 3)).with_mod_n(3, F.col("v"))
    p.join("joined", [a.bind("one"), b.bind("ten")], Sum, "value string").write("out")
    assert p.run()
    got = {k: sorted(v.decode().split()) for k, v in shards(tmp_path / "out").items()}
    assert got == {"out-shard-0000.txt": ["3:11"], "out-shard-0001.txt": ["1:1", "4:1"], "out-shard-0002.txt": ["2:11"]}
    assert p.counters["out"]["fn-writes"] == 4
    assert (tmp_path / "out" / "counter_map.csv").read_text() == "counter,value\nfn-writes,4\nmap-input-s1,4\nmap-input-s2,2\n"


def test_pipeline_json_custom_shards_and_parse_errors(spark, tmp_path):
    df = spark.createDataFrame([('{"foo":"bar"}',), ('{"id":1}',), ('{"foo":null}',), ("bad",)], "value string")
    p = Pipeline(spark, str(tmp_path))
    t = p.read("in", df).as_json().with_custom(F.when(files.json_has(F.col("value"), "foo"), "a/b/zed").otherwise("other"))
    t.write("w", compression="gzip")
    assert p.run()
    got = {k: sorted(gzip.decompress(v).decode().split("\n")[:-1]) for k, v in shards(tmp_path / "w").items()}
    assert got == {"a/b/zed.txt.gz": ['{"foo":"bar"}', '{"foo":null}'], "other.txt.gz": ['{"id":1}']}
    assert p.counters["w"] == {"fn-writes": 3, "fn-calls": 4, "parse-errors": 1, "map-input-in": 4}


@pytest.mark.parametrize(("fmt", "compression", "ext"), [("txt", "zstd", ".txt.zst"), ("lst", None, ".lst"), ("txt", None, ".txt")])
def test_formats(spark, tmp_path, fmt, compression, ext):
    p = Pipeline(spark, str(tmp_path))
    p.read("in", spark.createDataFrame([(f"r{k}",) for k in range(50)], "value string")).with_mod_n(2, F.substring("value", 2, 9).cast("int")).write("t", fmt, compression)
    assert p.run()
    got = shards(tmp_path / "t")
    assert set(got) == {f"t-shard-000{k}{ext}" for k in (0, 1)}
    data = got[f"t-shard-0001{ext}"]
    lines = list(lst.Decoder(data).records()) if fmt == "lst" else files.decompress(data).split(b"\n")[:-1]
    assert sorted(lines) == sorted(f"r{k}".encode() for k in range(1, 50, 2))


def test_rotation_and_reuse(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    p.read("in", spark.createDataFrame([(str(k),) for k in range(10)], "value string")).with_mod_n(1, F.lit(0)).write("t", max_records=4)
    assert p.run() and sorted(shards(tmp_path / "t")) == [f"t-shard-0000-00{k}.txt" for k in range(3)]
    back = files.read_text(spark, str(tmp_path / "t" / "*.txt"))
    assert back.count() == 10


def test_plan_errors(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    t = p.read("in", ints(spark, 1))
    with pytest.raises(PipelineError):
        t.write("x")
    with pytest.raises(PipelineError):
        p.read("in", ints(spark, 1))
    with pytest.raises(PipelineError):
        p.join("j", [t.bind("one")], Sum, "value string")
    with pytest.raises(PipelineError):
        p.join("j", [t.with_mod_n(2, F.col("v")).bind("one"), t.with_mod_n(3, F.col("v")).bind("ten")], Sum, "value string")
    with pytest.raises(PipelineError):
        p.join("j", [t.with_custom(F.lit("a")).bind("one")], Sum, "value string")
    with pytest.raises(PipelineError):
        t.with_mod_n(2, F.col("v")).write("y", "lst", "gzip")
    with pytest.raises(PipelineError):
        t.map("m", lambda d: d).as_json()
    p.stop()
    t.with_mod_n(2, F.col("v")).map("m", [F.col("v").cast("string").alias("value"), "shard"]).write("z")
    assert p.run() is False


def test_map_records_and_freq(spark, tmp_path):
    class Flush:
        def __init__(self):
            self.n = 0

        def do(self, r):
            self.n += 1
            yield (f"{r['value']}a", 1)

        def finish(self):
            yield ("total", self.n)

    p = Pipeline(spark, str(tmp_path))
    t = p.read("in", spark.createDataFrame([("kay",)] * 3 + [("lou",)] * 2, "value string").coalesce(1))
    out = t.map("m", Flush, "value string, n int").df.collect()
    assert sorted((r.value, r.n) for r in out) == sorted([("kaya", 1)] * 3 + [("loua", 1)] * 2 + [("total", 5)])
    p.freq_map("f", t.df, "value")
    assert {r.key: r.n for r in p.find_freq_map("f").collect()} == {"kay": 3, "lou": 2}
    with pytest.raises(PipelineError):
        p.freq_map("f", t.df, "value")
    with pytest.raises(KeyError):
        p.find_freq_map("none")


def test_nested_files_and_headers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("h\n1\n2\n")
    (tmp_path / "a" / "b" / "y.txt").write_text("h\n3\n")
    for kw in ({"skip_header": 1}, {"skip_header": 1, "with_position": True}):
        assert sorted(r.value for r in files.read_text(spark, f"{tmp_path}/a/**", **kw).collect()) == ["1", "2", "3"]
    assert files.read_text(spark, f"{tmp_path}/a/**").count() == 5


def test_positions_over_splits(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 97) for k in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "small.txt.gz", "wt") as f:
        f.write("head\na\r\nb\n")
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        df = files.read_text(spark, [f"{tmp_path}/big.txt", f"{tmp_path}/small.txt.gz"], skip_header=1, with_position=True)
        got = df.collect()
        assert files.read_text(spark, f"{tmp_path}/big.txt").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set(key, was)
    assert {(r.pos, r.value) for r in got if r.file.endswith("big.txt")} == {(k - 1, x) for k, x in enumerate(lines) if k}
    assert sorted((r.pos, r.value) for r in got if r.file.endswith(".gz")) == [(0, "a"), (1, "b")]


def test_csv_rows_of_several_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"two\nlines, and ""quotes"""\n\n2,plain\r\n"3\n","x"\n')
    got = files.read_csv_rows(spark, str(tmp_path / "m.csv"), header=True).orderBy("pos").collect()
    assert [r.fields for r in got] == [["1", 'two\nlines, and "quotes"'], ["2", "plain"], ["3\n", "x"]]
    assert [r.pos for r in got] == [0, 1, 2]


@pytest.mark.parametrize(("fmt", "compression"), [("txt", None), ("txt", "gzip"), ("txt", "zstd"), ("lst", None)])
def test_files_end_by_size_and_records(spark, tmp_path, fmt, compression):
    rows = spark.createDataFrame([(f"{k:099d}",) for k in range(100)], "value string")
    unpack = (lambda b: [bytes(r) for r in lst.Decoder(b).records()]) if fmt == "lst" else lambda b: files.decompress(b).split(b"\n")[:-1]
    for name, kw, most in (("size", {"max_bytes": 1000}, 11), ("records", {"max_records": 7}, 7)):
        p = Pipeline(spark, str(tmp_path / name))
        p.read("in", rows).with_mod_n(1, F.lit(0)).write("t", fmt, compression, **kw)
        assert p.run()
        got = [unpack(v) for v in shards(tmp_path / name / "t").values()]
        assert max(map(len, got)) <= most and len(got) >= 100 // most
        assert sorted(sum(got, [])) == [f"{k:099d}".encode() for k in range(100)]


def test_hot_shard_in_pieces_and_levels(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    p.read("in", spark.range(1000).select(F.col("id").cast("string").alias("value"))).with_custom(F.lit("all/in")).write("t", compression="gzip", level=9, pieces=4)
    assert p.run()
    got = shards(tmp_path / "t")
    assert 1 < len(got) <= 4 and all(n.startswith("all/in-00") for n in got)
    assert sorted(int(x) for v in got.values() for x in gzip.decompress(v).split()) == list(range(1000))


class Lookup(ShardHandler):
    def __init__(self, counter, names):
        self.counter, self.names = counter, names

    def ask(self, r):
        if r["v"] in self.names:
            yield to_shard(f"found/{r['v'] % 2}", f"{r['v']}={self.names[r['v']]}")
        else:
            self.counter.add("not-found")


def test_user_counters_arguments_and_routing(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    base = p.read("numbers", ints(spark, 1, 2, 2, 3, 4))
    p.freq_map("f", base.df, "v")
    names = {k: n for k, n in p.freq_dict("f").items() if k < 4}
    assert names == {1: 1, 2: 2, 3: 1}
    with pytest.raises(PipelineError):
        p.freq_dict("f", most=2)
    p.join("j", [base.with_mod_n(2, F.col("v")).bind("ask")], Lookup, "value string", (p.counter, names), named=True).write("out")

    def split(r, low, counter):
        counter.add("seen")
        if r["v"] < low:
            yield to_shard("low", str(r["v"]))
        else:
            yield (str(r["v"]),)

    base.route("r", split, "value string", (3, p.counter)).write("routed")
    assert p.run()
    text = lambda n: {k: sorted(v.decode().split()) for k, v in shards(tmp_path / n).items()}
    assert text("out") == {"found/0.txt": ["2=2", "2=2"], "found/1.txt": ["1=1", "3=1"]}
    assert text("routed") == {"low.txt": ["1", "2", "2"], "rest.txt": ["3", "4"]}
    assert p.counters["out"] == {"fn-writes": 4, "not-found": 1, "map-input-numbers": 5}
    assert p.counters["routed"]["seen"] == 5 and "not-found" not in p.counters["routed"]


def plans_of(spark, run):
    """The physical plans of the queries that ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [store.executionsList().apply(k).physicalPlanDescription() for k in range(known, store.executionsCount())]


def test_groups_of_a_task_come_together(monkeypatch):
    import pyarrow as pa

    from shardwright.operators import spool

    monkeypatch.setattr(spool, "HELD", 2000)  # nearly every batch goes to disk
    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 3, 1]), rng.randrange(3), k, {"a": str(k), "b": [k] * (k % 3)}) for k in range(3000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("gokx", r, strict=True)) for r in rows[k : k + 70]]) for k in range(0, 3000, 70)]
    got = [(key, r) for key, b in spool.together(batches, "g", "o") for r in zip(*(b.column(c).to_pylist() for c in "gokx"), strict=True)]
    assert [key for key, _ in got] == [r[:2] for _, r in got]
    assert sorted(r[2] for _, r in got) == list(range(3000)) and all(rows[r[2]] == r for _, r in got)
    keys = list(dict.fromkeys(key for key, _ in got))
    assert len(keys) == 12 and [key for key, _ in got] == [key for key in keys for k, _ in got if k == key]
    assert [k[1] for k in keys] == [0, 1, 2] * 4


class Order(ShardHandler):
    """Fails where an input comes before its turn; what it has seen comes at the end."""

    def start(self, shard):
        self.n, self.seen = 0, []
        yield (f"start {shard}",)

    def one(self, r):
        assert not self.n
        self.seen.append(r)

    def two(self, r):
        self.n += 1
        yield (f"{r['w']}/{len(self.seen)}",)

    def finish(self):
        assert all(r.keys() == {"v", "w"} for r in self.seen)
        return ((f"end {r['v']}",) for r in self.seen)


def test_join_keeps_the_order_of_inputs_without_a_sort(spark, tmp_path):
    n = 25_000
    a = spark.range(0, n, 1, 7).select(F.col("id").alias("v"), F.lit(None).cast("int").alias("w"), F.pmod("id", F.lit(3)).alias("shard"))
    b = spark.range(0, 90, 1, 5).select(F.struct("id").alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("w"), F.pmod("id", F.lit(3)).alias("shard"))
    out = join_shards([(a, "one"), (b, "two")], Order, 2, "value string", named=True)  # shards 0 and 2 share a task
    plan = out._jdf.queryExecution().toString()
    assert "Sort" not in plan  # a sort of a whole shard takes memory as the shard grows
    got = [(r.shard, r.value) for r in out.collect()]
    size = {s: len(range(s, n, 3)) for s in range(3)}
    assert sorted(got) == sorted(
        [(f"000{s}", f"start {s}") for s in range(3)]
        + [(f"000{k % 3}", f"{datetime.date(2020, 1, 1) + datetime.timedelta(k)}/{size[k % 3]}") for k in range(90)]
        + [(f"000{k % 3}", f"end {k}") for k in range(n)]
    )


@pytest.mark.parametrize("shards", [3, 250])
def test_text_sink_opens_files_instead_of_sorting(spark, tmp_path, shards):
    p = Pipeline(spark, str(tmp_path))
    p.read("in", spark.range(3000).select(F.col("id").cast("string").alias("value"))).with_custom(F.concat(F.lit("by/"), F.pmod("value", F.lit(shards)).cast("int"))).write("t", max_records=5)
    plans = plans_of(spark, p.run)
    assert plans and not any("Sort" in x for x in plans)
    got = {}
    for name, v in shards_of(tmp_path / "t"):
        lines = v.split()
        assert 0 < len(lines) <= 5
        got.setdefault(name, []).extend(map(int, lines))
    assert {k: sorted(v) for k, v in got.items()} == {f"by/{k}": list(range(k, 3000, shards)) for k in range(shards)}


def shards_of(path):
    return [(n.removesuffix(".txt").rpartition("-")[0], v) for n, v in shards(path).items()]


def test_file_names_are_parsed_once_a_file(spark, sf):
    from shardwright.queries import QUERIES

    df = QUERIES["handler_counters_and_routes"](spark, sf)
    assert "Aggregate [file" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("fmt", ["txt", "lst"])
@pytest.mark.parametrize("named", [True, False])
def test_framed_sink_has_no_sort(spark, tmp_path, fmt, named):
    p = Pipeline(spark, str(tmp_path))
    # 40 names over few tasks, and nulls
    rows = spark.range(0, 4000, 1, 7).select("id", F.when(F.col("id") % 10 != 9, F.concat(F.col("id").cast("string"), F.lit("x"))).alias("value"))
    t = p.read("in", rows)
    t = t.with_custom(F.concat(F.lit("a b/"), F.pmod("id", F.lit(40)).cast("string"))) if named else t.with_mod_n(3, F.col("id"))
    t.write("t", fmt, compression="zstd" if fmt == "txt" else None, max_bytes=500)
    plans = plans_of(spark, p.run)
    assert plans and not any("Sort" in x for x in plans)  # a sort of a whole shard takes memory as the shard grows
    got = {}
    for name, v in shards(tmp_path / "t").items():
        lines = list(lst.Decoder(v).records()) if fmt == "lst" else files.decompress(v).split(b"\n")[:-1]
        assert sum(len(x) + (fmt == "txt") for x in lines[:-1]) < 500
        got.setdefault(re.sub(r"(-\d{3})?[.].*", "", name), []).extend(lines)
    n, head = (40, "a b/{}") if named else (3, "t-shard-000{}")
    want = {head.format(k): [b"%dx" % i for i in range(k, 4000, n) if i % 10 != 9] for k in range(n)}
    assert {k: sorted(v, key=lambda x: int(x[:-1])) for k, v in got.items()} == {k: v for k, v in want.items() if v}
