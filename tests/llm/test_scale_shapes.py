"""Shapes that matter at scale: long documents, hot lines, hot keys, operators on their own output, no shared folder."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from shardwright.llm import common, line_dedup, mixing, packing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "a", 7) for r in rows], DOC)


def test_line_dedup_is_linear_in_a_document(spark):
    def seconds(n):
        text = "\n".join(f"a line that is long enough to be a key of its own, number {k}" for k in range(n))
        df = docs(spark, [(k, text) for k in range(6)])
        began = time.perf_counter()
        rows = line_dedup.line_dedup_report(df).collect()
        assert sorted(r.n_dropped for r in rows) == [0] + [n] * 5 and all(r.n_lines == n for r in rows)
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 20 * small + 5


def test_line_dedup_salted_join_gives_the_same(spark, monkeypatch):
    r = random.Random(1)
    line = "This line is long enough to be a key of its own, number "
    rows = [(k % 50, "\n".join(f"{line}{r.randint(0, 9)}" for _ in range(5))) for k in range(60)]
    want = collections.Counter(map(tuple, line_dedup.line_dedup_report(docs(spark, rows)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert collections.Counter(map(tuple, line_dedup.line_dedup_report(docs(spark, rows)).collect())) == want


def test_operators_take_their_own_output(spark):
    rows = [(k, "one two three\n" + "a line of forty characters or more, shared by all", "ab"[k % 2]) for k in range(12)]
    once = line_dedup.line_dedup(docs(spark, rows))
    twice = line_dedup.line_dedup(once)
    assert twice.columns == once.columns and twice.agg(F.sum("__dropped")).first()[0] == 0
    mixed = mixing.mix_sources(docs(spark, rows))
    assert mixing.mix_sources(mixed).columns == mixed.columns


def test_mix_places_against_brute_force(spark):
    """Block shares: in each block, sources hold about their weights; places are the permutation's own."""
    r = random.Random(3)
    rows = [(k, "w " * r.randint(1, 30), r.choices("abc", [80, 15, 5])[0]) for k in range(6000)]
    d = docs(spark, rows)
    plan = {p.source: p for p in mixing.plan_mixture(d, max_passes=3.0).collect()}
    got = mixing.mix_sources(d, max_passes=3.0, mix_blocks=10).withColumn("u", mixing._order(0, "doc_id")).withColumn("v", F.shiftrightunsigned(F.xxhash64("u", "__copy"), 1)).collect()
    share = collections.Counter()
    for x in got:
        p = plan[x.source]
        own = (x.u if x["__copy"] == p.full else x.v) / 2.0**63
        assert x["__mix_block"] == min(9, int((x["__copy"] + own) / p.passes * 10))
        assert x["__copy"] < p.full or x.u <= p.hash_limit
        share[x["__mix_block"], x.source] += len(x.text.split())
    for b in range(10):
        total = sum(share[b, s] for s in "abc")
        assert all(abs(share[b, s] / total - plan[s].weight) < 0.06 for s in "abc")


def test_pack_full_pieces_are_no_items(spark):
    rows = [(k, "x " * 1050, "a") for k in range(3)] + [(9, "x " * 200, "b"), (10, "", None)] + [(20, "y z", "a")] * 500
    got = packing.pack(docs(spark, rows), capacity=100, shard_items=50).collect()
    assert sum(g.bin_id < 0 for g in got) == 32 and len({g.bin_id for g in got if g.bin_id < 0}) == 32
    assert all(g.n_words == g.bin_words == 100 for g in got if g.bin_id < 0)
    shards = collections.Counter(g.bin_id >> 32 for g in got if g.bin_id >= 0)
    assert max(shards.values()) < 120  # equal rows don't meet in one shard
    pieces = collections.Counter((g.doc_id, g.piece, g.first_word) for g in got if g.doc_id in (0, 1, 2))
    assert pieces == collections.Counter((d, p, p * 100) for d in range(3) for p in range(11))


def test_hot_keys_are_met_where_they_lie(spark):
    rows = spark.range(25_000).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.createDataFrame([(7, 1), (None, 2)], "k long, id long"))
    table = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    table = table.unionByName(spark.createDataFrame([(9, 20_000, 5)], "k long, n long, top long"))
    got = common.meet_hot(rows, table.withColumn("n", F.col("n") + F.when(F.col("k") == 0, 90_000).otherwise(0)), "k", "n", 25_002, at_once=1)
    assert got.count() == 25_002 and got.where("k is null and top is null").count() == 1
    assert {(r.k, r.top) for r in got.select("k", "top").distinct().collect()} == {(0, 24999), (1, 24997), (2, 24998), (7, 1), (None, None)}


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.is_local("local[4]") and common.is_local("local") and not common.is_local("local-cluster[3,2,1000]") and not common.is_local("yarn")
