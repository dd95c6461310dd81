"""The library's queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import histogram, maths, text
from .operators import inspect, sharding
from .operators.cogroup import ShardHandler, join_shards, to_shard
from .operators.pipeline import Pipeline
from .operators.workspace import shared_dir
from .plang import compile_predicate
from .sources import files, lst
from .streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested records: each with its lines, in order of their numbers."""
    line = F.struct(F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("returnflag"), F.col("l_discount").alias("discount"), F.col("l_partkey").alias("partkey"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = table(spark, sf_dir, "orders")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "lines")


# ---- words, lines, grouping


@query("SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) GROUP BY w")
def word_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT w AS word, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) GROUP BY w")
def word_count_combined(spark, sf_dir):
    """Counts within each document first, then over documents: the documents of a word come for nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))
    per_doc = d.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").cast("bigint").alias("cnt"), F.count(F.lit(1)).alias("docs"))


@query("""SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, line FROM (
 SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE regexp_matches(line, 'th[ae]n?\\b')""")
def grep_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.where(F.col("line").rlike(r"th[ae]n?\b")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS cnt FROM orders GROUP BY 1")
def group_count_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT CAST(l_orderkey % 10 AS INTEGER) AS shard, count(*) AS cnt, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def modn_shard_sizes(spark, sf_dir):
    li = sharding.with_mod_shard(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), 10)
    return li.groupBy("shard").agg(F.count(F.lit(1)).alias("cnt"), F.sum("l_quantity").alias("qty"))


@query("SELECT CAST(((k % 4294967296) + 4294967296) % 4294967296 % 7 AS INTEGER) AS shard, count(*) AS cnt FROM (SELECT (o_orderkey - 5000) * 4000037 AS k FROM orders) GROUP BY 1")
def modn_shard_wraps(spark, sf_dir):
    """Keys beyond 32 bits lose their upper half and negative ones wrap."""
    o = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") - 5000) * F.lit(4000037).cast("bigint")).alias("k"))
    return o.groupBy(sharding.mod_n(F.col("k"), 7).alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT 'segment/' || c_mktsegment AS shard, count(*) AS cnt FROM customer GROUP BY 1")
def custom_shard_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("segment/"), "c_mktsegment").alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_strings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---- joins


@query("""SELECT l_orderkey, l_linenumber, p_name, p_brand, l_quantity FROM lineitem JOIN
 (SELECT p_partkey, p_name, p_brand FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""")
def hash_join_enrich(spark, sf_dir):
    """Lookup join: small dimension tables are broadcast by Catalyst from their size on disk, larger ones shuffled by key."""
    p = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey", "p_name", "p_brand")
    return table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "p_brand", "l_quantity")


@query("""SELECT count(*) FILTER (p_partkey IS NOT NULL) AS found, count(*) FILTER (p_partkey IS NULL) AS not_found
 FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""")
def join_miss_count(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    j = table(spark, sf_dir, "lineitem").select("l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.agg(F.count("p_partkey").alias("found"), F.count_if(F.col("p_partkey").isNull()).alias("not_found"))


@query("""SELECT l_orderkey, l_linenumber, last_order FROM lineitem LEFT JOIN
 (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON l_suppkey = o_custkey""")
def lookup_last_wins(spark, sf_dir):
    """A lookup whose build side has one row for each key: of duplicates the last."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    return table(spark, sf_dir, "lineitem").join(last, F.col("l_suppkey") == F.col("o_custkey"), "left").select("l_orderkey", "l_linenumber", "last_order")


@query("""SELECT coalesce(k1, k2) AS k, CAST(coalesce(a, 0) + 10 * coalesce(b, 0) AS BIGINT) AS total FROM
 (SELECT o_custkey AS k1, count(*) AS a FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey AS k2, count(*) AS b FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON k1 = k2""")
def merge_two_streams(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k1")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("k2")).agg(F.count(F.lit(1)).alias("b"))
    total = F.coalesce("a", F.lit(0)) + 10 * F.coalesce("b", F.lit(0))
    return a.join(b, F.col("k1") == F.col("k2"), "full").select(F.coalesce("k1", "k2").alias("k"), total.cast("bigint").alias("total"))


class _Merge(ShardHandler):
    def start(self, shard):
        self.sums: dict = {}
        return iter(())

    def one(self, r):
        self.sums[r["k"]] = self.sums.get(r["k"], 0) + 1

    def ten(self, r):
        self.sums[r["k"]] = self.sums.get(r["k"], 0) + 10

    def finish(self):
        yield from self.sums.items()


@query("""SELECT CAST(k % 5 AS INTEGER) AS shard, k, CAST(sum(v) AS BIGINT) AS total FROM
 (SELECT o_custkey AS k, 1 AS v FROM orders UNION ALL SELECT c_custkey, 10 FROM customer WHERE c_acctbal > 0) GROUP BY k""")
def shard_join_handlers(spark, sf_dir):
    """The same by handlers that see a shard's inputs one after the other."""
    a = sharding.with_mod_shard(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), F.col("k"), 5)
    b = sharding.with_mod_shard(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), F.col("k"), 5)
    return join_shards([(a, "one"), (b, "ten")], _Merge, 5, "k bigint, total bigint")


@query("SELECT event_id, user_id, n * 1089 + 2785 AS freq FROM events JOIN (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1) ON user_id = u")
def freq_map_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = e.groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, F.col("user_id") == F.col("u")).select("event_id", "user_id", (F.col("n") * 1089 + 2785).alias("freq"))


@query("""SELECT CAST(cnt % 3 AS INTEGER) AS shard, count(*) AS keys, CAST(sum(cnt) AS BIGINT) AS total FROM
 (SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1) GROUP BY 1""")
def reshard_after_join(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("cnt"))
    return sharding.with_mod_shard(c, F.col("cnt"), 3).groupBy("shard").agg(F.count(F.lit(1)).alias("keys"), F.sum("cnt").alias("total"))


@query("SELECT e.event_id, e.user_id, max(p.event_id) AS last_signup FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'signup' AND (p.ts, p.event_id) <= (e.ts, e.event_id) AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'signup' AND (q.ts, q.event_id) <= (e.ts, e.event_id) AND (q.ts, q.event_id) > (p.ts, p.event_id)) GROUP BY 1, 2")
def as_of_last(spark, sf_dir):
    """The last sign-up of the user at or before each event: one sort by user and time instead of a join."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "user_id", last.alias("last_signup"))


# ---- parsing


@query("""SELECT count(*) AS fn_calls, count(*) FILTER (v IS NULL) AS parse_errors, CAST(coalesce(sum(v), 0) AS VARCHAR) AS total
 FROM (SELECT CASE WHEN regexp_full_match(w, '[0-9]+') THEN TRY_CAST(w AS BIGINT) END AS v FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z]+')) AS w FROM documents))""")
def parse_errors_counter(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([0-9A-Za-z]+)"), 1)).alias("w"))
    v = w.select(text.parse_int(F.col("w")).alias("v"))
    return v.agg(F.count(F.lit(1)).alias("fn_calls"), F.count_if(F.col("v").isNull()).alias("parse_errors"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"))


@query("SELECT CASE WHEN json_exists(props, '$.k') THEN 'shard0' ELSE 'shard1' END AS shard, count(*) AS cnt FROM events GROUP BY 1")
def json_member_shard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.when(files.json_has(F.col("props"), "k"), "shard0").otherwise("shard1").alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'T' || event_type AS tag FROM events WHERE json_valid(props)")
def json_enrich_roundtrip(spark, sf_dir):
    """Parse, add a member, print, parse again."""
    e = files.parse_json(table(spark, sf_dir, "events"), "k bigint", "props").where("json is not null")
    printed = F.to_json(F.struct("json.k", F.concat(F.lit("T"), "event_type").alias("tag")))
    return e.select("event_id", F.from_json(printed, "k bigint, tag string").alias("x")).select("event_id", "x.k", "x.tag")


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(4 AS INTEGER) AS n_fields FROM nation")
def csv_split_fields(spark, sf_dir):
    """Lines with quotes, white space and a trailing delimiter, split again."""
    quoted = F.concat(F.lit('"'), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" ,"), quoted, F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(",")).alias("line"))
    f = lines.select(text.csv_fields(F.col("line")).alias("f"))
    return f.select(F.col("f")[0].cast("int").alias("n_nationkey"), F.col("f")[1].alias("n_name"), F.col("f")[2].cast("int").alias("n_regionkey"), F.size("f").alias("n_fields"))


@query("SELECT meta, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM (SELECT 42 AS meta, * FROM orders UNION ALL SELECT 43, * FROM orders WHERE o_orderstatus = 'F') GROUP BY meta")
def union_with_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    u = o.withColumn("meta", F.lit(42)).unionByName(o.where("o_orderstatus = 'F'").withColumn("meta", F.lit(43)))
    return u.groupBy("meta").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS kept FROM documents WHERE len(string_split(text, chr(10))) > 1")
def skip_header_per_file(spark, sf_dir):
    """Each document taken as a file whose first line is a header."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("pos >= 1")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\\p{L}\\p{N}_\\p{P}\\s]', ' ', 'g')) AS body FROM pages""")
def wet_pages_clean(spark, sf_dir):
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[^\p{L}\p{N}_\p{P}\s]", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(body).alias("body"))


# ---- the predicate language

_ENUM = {"o_orderstatus": {"F": 0, "O": 1, "P": 2}}


def _where(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(compile_predicate(predicate, df.schema, _ENUM))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR c_nationkey <= 3")
def plang_basic(spark, sf_dir):
    return _where(table(spark, sf_dir, "customer"), "c_mktsegment = 'BUILDING' && c_acctbal > 5000 or c_nationkey <= 3").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 1 OR (c_nationkey > 5 AND NOT (c_acctbal < 0))")
def plang_precedence(spark, sf_dir):
    return _where(table(spark, sf_dir, "customer"), "c_nationkey = 1 OR c_nationkey > 5 AND not c_acctbal < 0").select("c_custkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def plang_not_equal(spark, sf_dir):
    """!= on a repeated field: no element is equal."""
    return _where(nested_orders(spark, sf_dir), "lines.returnflag != 'R'").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '(ECO|STA).*') AND NOT regexp_full_match(p_brand, 'Brand#1.?') AND NOT regexp_full_match(p_type, 'MED')")
def plang_rlike(spark, sf_dir):
    """The whole text has to match."""
    return _where(table(spark, sf_dir, "part"), "p_type RLIKE '(ECO|STA).*' and not p_brand regexp \"Brand#1.?\" and not p_type rlike 'MED'").select("p_partkey")


@query("SELECT p_partkey, price FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12, 2)) AS price FROM part) WHERE price > 1000.25 AND price <= 1500.75 AND price <> 1200.5")
def plang_decimal(spark, sf_dir):
    """Decimals keep their fraction."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return _where(p, "price > 1000.25 and price <= 1500.75 and price != 1200.5")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND o_orderstatus <> 'P'")
def plang_def_enum(spark, sf_dir):
    """Presence of a repeated field, and an enum against its number."""
    return _where(nested_orders(spark, sf_dir), "def(lines) and o_orderstatus != 2").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity < 5)""")
def plang_repeated_any(spark, sf_dir):
    """Two conditions on a repeated field need not hold for the same element."""
    return _where(nested_orders(spark, sf_dir), "lines.returnflag = 'R' and lines.quantity < 5").select("o_orderkey")


# ---- inspection


@query("""SELECT o_orderkey || ',' || l_linenumber || ',' || l_returnflag AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def csv_project_lines(spark, sf_dir):
    """Two fields under one repeated ancestor go together."""
    return inspect.csv_project(nested_orders(spark, sf_dir), ["o_orderkey", "lines.linenumber", "lines.returnflag"])


@query("""SELECT a.k || ',' || a.f || ',' || b.q AS line FROM
 (SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem) a JOIN (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS q FROM lineitem) b ON a.k = b.k""")
def csv_project_cross(spark, sf_dir):
    """Two repeated fields give all combinations."""
    n = nested_orders(spark, sf_dir)
    n = n.where("lines is not null").select("o_orderkey", F.col("lines.returnflag").alias("flags"), F.col("lines.linenumber").alias("numbers"))
    return inspect.csv_project(n, ["o_orderkey", "flags", "numbers"])


@query("""SELECT l_orderkey || ',"' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) || '"' AS line FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey""")
def aggregate_repeated(spark, sf_dir):
    n = nested_orders(spark, sf_dir).where("lines is not null").select("o_orderkey", F.sort_array("lines.linenumber").alias("numbers"))
    return inspect.csv_project(n, ["o_orderkey", "numbers"], aggregate_repeated=True)


@query("""SELECT * FROM (SELECT 'p_partkey' AS path, CAST(8 * count(p_partkey) AS BIGINT) AS bytes FROM part UNION ALL SELECT 'p_name', sum(octet_length(encode(p_name))) FROM part
 UNION ALL SELECT 'p_brand', sum(octet_length(encode(p_brand))) FROM part UNION ALL SELECT 'p_type', sum(octet_length(encode(p_type))) FROM part
 UNION ALL SELECT 'p_size', 4 * count(p_size) FROM part UNION ALL SELECT 'p_retailprice', 8 * count(p_retailprice) FROM part) WHERE bytes > 0""")
def field_sizes(spark, sf_dir):
    return inspect.field_sizes(table(spark, sf_dir, "part"))


@query("""WITH l AS (SELECT * FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)), s AS (SELECT 'lines.linenumber' AS path, 4 * count(l_linenumber) AS bytes FROM l
 UNION ALL SELECT 'lines.quantity', 8 * count(l_quantity) FROM l UNION ALL SELECT 'lines.returnflag', sum(octet_length(encode(l_returnflag))) FROM l UNION ALL SELECT 'lines.discount', 8 * count(l_discount) FROM l UNION ALL SELECT 'lines.partkey', 8 * count(l_partkey) FROM l)
 SELECT path, CAST(bytes AS BIGINT) AS bytes FROM s UNION ALL SELECT 'lines', CAST(sum(bytes) AS BIGINT) FROM s""")
def field_sizes_nested(spark, sf_dir):
    return inspect.field_sizes(nested_orders(spark, sf_dir).select("lines"))


@query()
def sample_by_key(spark, sf_dir):
    return inspect.sample_by_key(table(spark, sf_dir, "customer"), "c_name", 10).select("c_custkey", "c_name")


_LIMITS = ", ".join(f"({i}, {x!r})" for i, x in enumerate(histogram.LIMITS))
_BUCKETS = f"""WITH b(i, hi) AS (VALUES {_LIMITS}), h AS (SELECT (SELECT count(*) FROM b WHERE i < 153 AND hi <= l_extendedprice) AS bucket, l_extendedprice AS v FROM lineitem),
 c AS (SELECT bucket, count(*) AS n FROM h GROUP BY 1)"""


@query("SELECT count(*) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS average, round(stddev_pop(l_extendedprice), 4) AS stddev FROM lineitem")
def histogram_stats(spark, sf_dir):
    s = histogram.stats(histogram.bucket_counts(table(spark, sf_dir, "lineitem"), "l_extendedprice"))
    return s.withColumn("average", F.round("average", 4)).withColumn("stddev", F.round("stddev", 4))


@query(_BUCKETS + " SELECT CAST(bucket AS INTEGER) AS bucket, n FROM c")
def histogram_buckets(spark, sf_dir):
    return histogram.bucket_counts(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bucket", "n")


@query(_BUCKETS + """, u AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto FROM c), p(p) AS (VALUES (10.0::DOUBLE), (50.0), (90.0), (99.0)), t AS (SELECT count(*) AS all_n, min(v) AS lo, max(v) AS hi FROM h),
 r AS (SELECT p, CAST(floor(all_n * (p / 100.0)) AS BIGINT) AS rank, lo, hi FROM p, t), f AS (SELECT r.*, (SELECT min(bucket) FROM u WHERE upto >= rank) AS bk FROM r)
 SELECT p, round(greatest(f.lo, least(f.hi, lower + (upper - lower) * (rank - (upto - n)) / (n + 1))), 4) AS value FROM (
 SELECT f.*, u.n, u.upto, coalesce((SELECT b.hi FROM b WHERE b.i = bk - 1), 0) AS lower, (SELECT b.hi FROM b WHERE b.i = bk) AS upper FROM f JOIN u ON u.bucket = bk) f""")
def histogram_percentile(spark, sf_dir):
    p = histogram.percentiles(histogram.bucket_counts(table(spark, sf_dir, "lineitem"), "l_extendedprice"), [10, 50, 90, 99])
    return p.withColumn("value", F.round("value", 4))


# ---- windows of time


@query("""WITH b AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT event_type, bin, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM b""")
def sliding_counter(spark, sf_dir):
    return counters.sliding_sums(table(spark, sf_dir, "events"), "ts", ["event_type"], 6, 3600)


@query("""SELECT start, event_type, count(value) AS count, round(sum(value), 6) AS total, round(sum(value) / count(value), 6) AS average FROM (
 SELECT date_trunc('minute', ts) - INTERVAL 1 MINUTE * k AS start, event_type, value FROM events, (SELECT unnest(range(5)) AS k)) GROUP BY 1, 2""")
def avg5m_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    a = counters.averages(e, "ts", ["event_type"], "value")
    return a.withColumn("total", F.round("total", 6)).withColumn("average", F.round("average", 6))


@query("""WITH b AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT user_id, bin, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY bin RANGE BETWEEN 9 PRECEDING AND 1 PRECEDING), 0) // 9 AS BIGINT) AS qps FROM b""")
def qps_by_user(spark, sf_dir):
    return counters.rate(table(spark, sf_dir, "events"), "ts", ["user_id"])


# ---- functions

_SCALE = "CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fK', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2fM', (n // 1024) / 1024.0) ELSE printf('%.2fG', (n // 1048576) / 1024.0) END"


@query(f"SELECT doc_id, {_SCALE} AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 3 * 4099) AS n FROM documents)")
def human_bytes(spark, sf_dir):
    n = F.col("n_chars") * (1 + F.col("doc_id") % 3 * 4099)
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(n).alias("size"))


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.2fk', n / 1000.0) ELSE printf('%.2fM', (n // 1000) / 1000.0) END AS num FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 5)) AS BIGINT) AS n FROM orders)")
def human_numbers(spark, sf_dir):
    n = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.human_int(n).alias("num"))


@query("SELECT o_orderkey, upper(to_base(o_orderkey * 7919, 36)) AS b36, lower(lpad(hex(o_orderkey), 16, '0')) AS h64 FROM orders")
def base36_hex64(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.to_base(F.col("o_orderkey") * 7919, 36).alias("b36"), text.hex64(F.col("o_orderkey")).alias("h64"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS enc FROM pages")
def url_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_encode(F.col("url")).alias("enc"))


@query("SELECT page_id, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, regexp_extract(path, '([^/]*)$', 1) AS base, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages)")
def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    return p.select("page_id", text.file_extension(F.col("path")).alias("ext"), text.base_name(F.col("path")).alias("base"), text.dir_name(F.col("path")).alias("dir"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_discount * 3 - (l_discount + l_discount + l_discount)) <= 7.105427357601002e-15 AS same,
 greatest(1000.0, least(l_extendedprice, 20000.0)) AS clamped, CAST(sign(l_discount - 0.05) AS INTEGER) AS sgn FROM lineitem""")
def almost_equals_clamp_sign(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", maths.almost_equal(d * 3, d + d + d).alias("same"), maths.clamp(F.col("l_extendedprice"), 1000.0, 20000.0).alias("clamped"), maths.sign(d - 0.05).alias("sgn"))


@query("""SELECT vec_id, round(sqrt(s), 6) AS norm, round(d, 6) AS with_reverse, CAST(big - 1 AS INTEGER) AS largest FROM (SELECT vec_id, list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) AS s,
 list_sum([a::DOUBLE * b::DOUBLE for a, i in embedding if true]) AS d0, 0 AS z, list_position([abs(x) for x in embedding], list_max([abs(x) for x in embedding])) AS big,
 list_sum([embedding[i]::DOUBLE * embedding[65 - i]::DOUBLE for i in range(1, 65)]) AS d FROM embeddings)""".replace("\n list_sum([a::DOUBLE * b::DOUBLE for a, i in embedding if true]) AS d0, 0 AS z,", ""))
def vector_norm_dot(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(maths.norm(e), 6).alias("norm"), F.round(maths.dot(e, F.reverse(e)), 6).alias("with_reverse"), maths.largest_abs_component(e).alias("largest"))


@query("""SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS gap FROM orders""")
def deltas(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))).alias("gap"))


@query("SELECT DISTINCT o_custkey, o_orderkey FROM orders")
def delta_round_trip(spark, sf_dir):
    """The codes of delta_encode, decoded."""
    c = delta_encode(spark, sf_dir)
    keys = c.select("o_custkey", "high", F.explode(maths.delta_decode(F.col("code"))).alias("low"))
    return keys.select("o_custkey", (F.shiftleft("high", 15) + F.col("low")).alias("o_orderkey"))


@query()
def delta_encode(spark, sf_dir):
    """Codes hold 16 bits, of which doubling may take one: keys go by the part above 15 bits, and each (customer, high part) has its own code."""
    k = F.col("o_orderkey")
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey", F.shiftright(k, 15).alias("high")).agg(F.array_sort(F.collect_set(k.bitwiseAND(32767).cast("int"))).alias("keys"))
    return keys.select("o_custkey", "high", maths.delta_encode(F.col("keys")).alias("code"))


@query("""SELECT s_nationkey, round(sum(2 * 6372797.560856 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 2) AS metres
 FROM (SELECT s_nationkey, (s_suppkey % 180)::DOUBLE AS lon1, (s_suppkey % 90)::DOUBLE AS lat1, (s_suppkey * 7 % 180)::DOUBLE AS lon2, (s_suppkey * 3 % 90)::DOUBLE AS lat2 FROM supplier) GROUP BY 1""")
def haversine_length(spark, sf_dir):
    k = F.col("s_suppkey")
    d = maths.haversine_m((k % 180).cast("double"), (k % 90).cast("double"), (k * 7 % 180).cast("double"), (k * 3 % 90).cast("double"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.sum(d), 2).alias("metres"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(length(bin(o_orderkey)) - 1 AS INTEGER) END AS top_bit, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(length(bin(o_orderkey - 1)) AS INTEGER) END AS pow2 FROM orders")
def bit_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, maths.log2_floor(k).alias("top_bit"), F.bit_count(k).alias("ones"), maths.next_power_of_2(k).alias("pow2"))


@query("SELECT doc_id, octet_length(encode(text)) - octet_length(encode(replace(text, 'e', ''))) AS es, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n_lines FROM documents")
def count_bytes_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.count_byte(F.col("text"), "e").cast("bigint").alias("es"), F.size(text.lines(F.col("text"))).cast("bigint").alias("n_lines"))


# ---- sets, order, codecs, streams


@query("SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION ALL SELECT k, 'customer' FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 5 EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.subtract(a).withColumn("side", F.lit("customer")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf_dir):
    """A top-k report: each task keeps k rows."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("SELECT o_orderkey, l_linenumber AS n, l_returnflag AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def explode_json_array(spark, sf_dir):
    """Printed Python lists of records, cleaned, parsed and flattened with their parent's key."""
    line = lambda x: F.format_string("{'n': %d, 'flag': '%s', 'path': None}", x.linenumber, x.returnflag)
    dirty = nested_orders(spark, sf_dir).where("lines is not null").select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform("lines", line), ", "), F.lit("]")).alias("j"))
    x = F.explode(F.from_json(text.python_json(F.col("j")), "array<struct<n: int, flag: string>>"))
    return dirty.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.n", "x.flag")


@query("SELECT c_custkey, c_name FROM customer")
def lst_round_trip(spark, sf_dir):
    """Records through the block format and back, one block file for each task, in memory."""
    from .sources.lst import Decoder, encode

    def write(batches):
        import pyarrow as pa

        for b in batches:
            data = b"".join(encode((f"{k},{n}".encode() for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), {"kind": b"customer"}, compress=True))
            yield pa.RecordBatch.from_arrays([pa.array([data])], ["file"])

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in Decoder(data).records()], pa.string())], ["line"])

    back = table(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInArrow(write, "file binary").mapInArrow(read, "line string")
    f = back.select(text.csv_fields(F.col("line")).alias("f"))
    return f.select(F.col("f")[0].cast("bigint").alias("c_custkey"), F.col("f")[1].alias("c_name"))


@query("SELECT vec_id, round(m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7]) + m[3] * (m[4] * m[8] - m[5] * m[7]), 8) AS det, round(m[1] + m[5] + m[9], 6) AS trace FROM (SELECT vec_id, [x::DOUBLE for x in embedding[1:9]] AS m FROM embeddings)")
def matrix_det_trace(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    m = F.array(*(F.slice(e, 3 * i + 1, 3) for i in range(3)))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.round(maths.det3(F.col("m")), 8).alias("det"), F.round(maths.trace3(F.col("m")), 6).alias("trace"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size || 'B' WHEN p_size < 30 THEN p_size || '.5K' ELSE p_size || 'M' END AS size, CASE WHEN p_size < 10 THEN p_size WHEN p_size < 30 THEN (p_size + 0.5) * 1024 ELSE p_size * 1048576 END::DOUBLE AS bytes FROM part")
def parse_human_sizes(spark, sf_dir):
    n = F.col("p_size").cast("string")
    size = F.when(F.col("p_size") < 10, F.concat(n, F.lit("B"))).when(F.col("p_size") < 30, F.concat(n, F.lit(".5K"))).otherwise(F.concat(n, F.lit("M")))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size")).withColumn("bytes", text.parse_human_bytes(F.col("size")))


@query()
def line_hash_shards(spark, sf_dir):
    """Lines dealt into named shards by a stable hash."""
    from .functions.hashing import xxh3_shard

    d = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy(F.format_string("shard-%04d", xxh3_shard(F.col("line"), 10)).alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("""SELECT CAST(epoch(date_trunc('hour', ts)) + 3600 * (k + 1) AS BIGINT) AS end_s, event_type, count(*) AS total
 FROM events, (SELECT unnest(range(6)) AS k) GROUP BY 1, 2""")
def stream_sliding_counts(spark, sf_dir):
    """The sliding counter as a stream that reads the events as files, run until it has seen all of them."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = f"{shared_dir(spark)}/sliding-{uuid.uuid4().hex}"
    counts = counters.stream_counts(stream, "ts", ["event_type"], 6, 3600)

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{at}/result")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/result").select(F.unix_seconds("end").alias("end_s"), "event_type", "total")


# ---- more functions


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:3]] AS v FROM embeddings), k AS (SELECT *, list_position([abs(x) for x in v], list_max([abs(x) for x in v])) - 1 AS top FROM e),
 a AS (SELECT *, [CASE WHEN (top + 2) % 3 = i THEN 1.0 ELSE 0.0 END for i in range(3)] AS x FROM k), c AS (SELECT *, [v[2] * x[3] - v[3] * x[2], v[3] * x[1] - v[1] * x[3], v[1] * x[2] - v[2] * x[1]] AS o FROM a)
 SELECT vec_id, round(o[1] / sqrt(o[1] * o[1] + o[2] * o[2] + o[3] * o[3]), 6) + 0.0 AS o1, round(o[2] / sqrt(o[1] * o[1] + o[2] * o[2] + o[3] * o[3]), 6) + 0.0 AS o2, CAST(floor(v[1] * 10) AS BIGINT) AS low, CAST(ceil(v[2] * 10) AS BIGINT) AS high,
 CAST(list_position([abs(x) for x in v], list_min([abs(x) for x in v])) - 1 AS INTEGER) AS least, v < [v[2], v[1], v[3]] AS before FROM c""")
def vector_components(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    o, ten = maths.unit_orthogonal(F.col("v")), maths.scale(F.col("v"), 10.0)
    return e.select(
        "vec_id", (F.round(o[0], 6) + 0.0).alias("o1"), (F.round(o[1], 6) + 0.0).alias("o2"), maths.each(ten, "floor")[0].alias("low"), maths.each(ten, "ceil")[1].alias("high"),
        maths.component_order(F.col("v"))[0].alias("least"), maths.vector_less(F.col("v"), F.array(F.col("v")[1], F.col("v")[0], F.col("v")[2])).alias("before"),
    )


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:9]] AS m, sqrt(embedding[1]::DOUBLE * embedding[1] + embedding[2]::DOUBLE * embedding[2] + embedding[3]::DOUBLE * embedding[3]) AS t FROM embeddings)
 SELECT vec_id, round(m[5] * m[9] - m[6] * m[8], 8) + 0.0 AS adj11, round(m[3] * m[8] - m[2] * m[9], 8) + 0.0 AS adj12, round(m[1] + m[1], 8) AS sum11, round(m[2] - m[4], 8) + 0.0 AS diff12, round(1 + 2 * cos(t), 6) AS turn_trace,
 round((m[1] * m[1] + m[2] * m[2] + m[3]) / (m[7] * m[1] + m[8] * m[2] + m[9]), 4) AS px FROM e""")
def matrix_parts(spark, sf_dir):
    x = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(F.slice(x, 3 * i + 1, 3) for i in range(3))).alias("m"))
    m, t = F.col("m"), maths.transpose3(F.col("m"))
    return e.select(
        "vec_id", (F.round(maths.adjugate3(m)[0][0], 8) + 0.0).alias("adj11"), (F.round(maths.adjugate3(m)[0][1], 8) + 0.0).alias("adj12"), F.round(maths.mat_add3(m, t)[0][0], 8).alias("sum11"),
        (F.round(maths.mat_sub3(m, t)[0][1], 8) + 0.0).alias("diff12"), F.round(maths.trace3(maths.rotation3(m[0])), 6).alias("turn_trace"), F.round(maths.project2(m, F.slice(m[0], 1, 2))[0], 4).alias("px"),
    )


@query("SELECT o_orderkey, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS zz, n AS back, CAST(greatest(1, ceil(length(bin(CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END)) / 7.0)) AS INTEGER) AS size, upper(lpad(hex(o_orderkey % 128), 2, '0')) AS one FROM (SELECT o_orderkey, (o_orderkey - 3000) * 977 AS n FROM orders)")
def integer_coders(spark, sf_dir):
    n = ((F.col("o_orderkey") - 3000) * 977).alias("n")
    z = table(spark, sf_dir, "orders").select("o_orderkey", n).withColumn("zz", maths.zigzag(F.col("n")))
    return z.select("o_orderkey", "zz", maths.unzigzag(F.col("zz")).alias("back"), maths.varint_size(F.col("zz")).alias("size"), F.hex(maths.varint(F.col("o_orderkey") % 128)).alias("one"))


@query("""SELECT o_orderkey, CAST(TRY_CAST(big AS UINTEGER) AS BIGINT) AS u32, coalesce(TRY_CAST(nullif(regexp_extract(mixed, '^[0-9]+'), '') AS BIGINT), -1) AS dec, coalesce(TRY_CAST(TRY_CAST(nullif(regexp_extract(wide, '^[0-9]+'), '') AS INTEGER) AS BIGINT), 7) AS i32
 FROM (SELECT o_orderkey, CAST(o_orderkey * 1000003 AS VARCHAR) AS big, '00' || o_orderkey || 'x' AS mixed, (o_orderkey * 1500007) || ' rest' AS wide FROM orders)""")
def parse_numbers_more(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, (k * 1000003).cast("string").alias("big"), F.concat(F.lit("00"), k.cast("string"), F.lit("x")).alias("mixed"), F.concat((k * 1500007).cast("string"), F.lit(" rest")).alias("wide"))
    return o.select("o_orderkey", text.parse_uint(F.col("big")).alias("u32"), text.leading_number(F.col("mixed"), -1).alias("dec"), text.leading_number(F.col("wide"), 7, bits=32).alias("i32"))


@query("""SELECT page_id, CAST(length(regexp_extract(url, '^[a-z]*')) AS INTEGER) AS letters, CAST(length(regexp_extract(url, '^[^/.]*')) AS INTEGER) AS upto, regexp_replace(url, '[^0-9]', '', 'g') AS digits, CAST(strpos(url, 'example') - 1 AS INTEGER) AS at,
 CAST(length(url) - strpos(reverse(url), '/') AS INTEGER) AS last_slash, split_part(url, '://', 1) AS head, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages""")
def string_ranges(spark, sf_dir):
    u, small = F.col("url"), "abcdefghijklmnopqrstuvwxyz"
    p = table(spark, sf_dir, "pages").select("page_id", u, text.split_step(u, "://").alias("s"))
    return p.select("page_id", text.span(u, small).alias("letters"), text.span_not(u, "/.").alias("upto"), text.keep_chars(u, "0123456789").alias("digits"), text.find(u, "example").alias("at"), text.find_last(u, "/").alias("last_slash"), "s.head", "s.rest")


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(2 AS BIGINT) AS fields FROM nation")
def xml_fields(spark, sf_dir):
    """Paths into XML records."""
    x = F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name><region id='"), F.col("n_regionkey").cast("string"), F.lit("'/></nation>"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x"))
    return n.select("n_nationkey", F.xpath_string("x", F.lit("nation/name")).alias("name"), F.xpath_long("x", F.lit("nation/region/@id")).alias("region"), F.xpath_long("x", F.lit("count(nation/*)")).alias("fields"))


@query()
def tuple_hashes(spark, sf_dir):
    """XXH64 of a tuple of a number and a string."""
    from .functions.hashing import xxh64_of

    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", xxh64_of(F.col("c_custkey"), F.col("c_name")).alias("h"))


# ---- files: written to the shared folder and read again


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _last(file):
    """A path's last name: a pattern that may begin anywhere takes time by the square of a path's length."""
    return F.substring_index(file, "/", -1)


@query("SELECT c_custkey, c_name, c_mktsegment AS shard FROM customer")
def text_sink_round_trip(spark, sf_dir):
    """Named shards as gzip text, read with all files below the folder."""
    p = Pipeline(spark, _folder(spark))
    line = F.concat_ws("|", "c_custkey", "c_name").alias("value")
    p.read("customers", table(spark, sf_dir, "customer").select(line, F.concat(F.lit("by/segment/"), "c_mktsegment").alias("to"))).with_custom(F.col("to")).write("out", compression="gzip")
    p.run()
    back = files.read_text(spark, f"{p.root}/out/by/**").select(F.split("value", "[|]").alias("f"), F.regexp_extract(_last("file"), "(.*)[.]txt[.]gz$", 1).alias("shard"))
    return back.select(F.col("f")[0].cast("bigint").alias("c_custkey"), F.col("f")[1].alias("c_name"), "shard")


@query("SELECT CAST(o_orderkey % 3 AS INTEGER) AS shard, o_orderkey, o_orderstatus FROM orders")
def zstd_sink_round_trip(spark, sf_dir):
    """Numbered shards as zstd text whose files end by raw size; read by their content."""
    p = Pipeline(spark, _folder(spark))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"))
    p.read("orders", o).with_mod_n(3, F.col("o_orderkey")).write("out", compression="zstd", max_bytes=1 << 20)
    p.run()
    back = files.read_any(spark, f"{p.root}/out/*.zst").select(F.split("value", ",").alias("f"), F.regexp_extract(_last("file"), "shard-([0-9]{4})", 1).cast("int").alias("shard"))
    return back.select("shard", F.col("f")[0].cast("bigint").alias("o_orderkey"), F.col("f")[1].alias("o_orderstatus"))


@query("SELECT CAST(p_partkey % 4 AS INTEGER) AS shard, p_partkey, p_name FROM part")
def lst_sink_round_trip(spark, sf_dir):
    """Numbered shards as record files, which are limited to 500 records each."""
    p = Pipeline(spark, _folder(spark))
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", "p_partkey", "p_name").alias("value"))
    p.read("parts", part).with_mod_n(4, F.col("p_partkey")).write("out", "lst", max_records=500)
    p.run()
    back = lst.read_lst(spark, f"{p.root}/out/*.lst").select(F.split(F.decode("record", "utf-8"), ";").alias("f"), F.regexp_extract(_last("file"), "shard-([0-9]{4})", 1).cast("int").alias("shard"))
    return back.select("shard", F.col("f")[0].cast("bigint").alias("p_partkey"), F.col("f")[1].alias("p_name"))


@query("SELECT r_name AS region, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS BIGINT) AS pos, n_name AS value, CAST(7 AS BIGINT) AS meta FROM region JOIN nation ON n_regionkey = r_regionkey")
def header_positions(spark, sf_dir):
    """A file for each region, with a header; lines come with their positions after it."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    p = Pipeline(spark, _folder(spark))
    p.read("regions", n.select(F.concat(F.lit("name\r\n"), F.array_join("names", "\r\n"), F.lit("\r")).alias("value"), "r_name")).with_custom(F.col("r_name")).write("out")
    p.run()
    back = files.read_text(spark, [files.FileSpec(f"{p.root}/out/*.txt", i64=7)], skip_header=1, with_position=True)
    return back.select(F.regexp_extract(_last(F.url_decode("file")), "(.*)[.]txt$", 1).alias("region"), "pos", "value", F.col("meta.i64").alias("meta"))


@query("SELECT s_suppkey, s_name || chr(10) || '\"' || s_nationkey || '\"' AS note FROM supplier")
def csv_rows_round_trip(spark, sf_dir):
    """Quoted fields that hold line feeds and quotes."""
    p = Pipeline(spark, _folder(spark))
    note = F.concat(F.lit('"'), "s_name", F.lit('\n""'), F.col("s_nationkey").cast("string"), F.lit('"""'))
    p.read("suppliers", table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit(","), note).alias("value"))).with_mod_n(2, F.col("s_suppkey")).write("out")
    p.run()
    f = files.read_csv_rows(spark, f"{p.root}/out/*.txt").select("fields")
    return f.select(F.col("fields")[0].cast("bigint").alias("s_suppkey"), F.col("fields")[1].alias("note"))


@query("""SELECT 'http://p/' || page_id AS uri, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\\p{L}0-9_\\p{P}\\s]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body, CAST(0 AS BIGINT) AS bad_lines FROM pages""")
def wet_archive_pages(spark, sf_dir):
    """Pages as an archive of extracted text, read record by record."""
    p = Pipeline(spark, _folder(spark))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://p/"), F.col("page_id").cast("string"), F.lit("\r\nContent-Type: text/plain\r\n\r\n"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.regexp_replace("html", "<[^>]*>", " "), F.lit("\r\n\r\n")).alias("value"))
    p.read("pages", pages).with_mod_n(3, F.col("page_id")).write("out", compression="gzip")
    p.run()
    return files.read_wet(spark, f"{p.root}/out/*.gz").select("uri", "body", "bad_lines")


class _Names(ShardHandler):
    """Looks names up and counts what it does not find."""

    def __init__(self, counter):
        self.counter = counter

    def start(self, shard):
        self.names: dict = {}
        return iter(())

    def name(self, r):
        self.names[r["k"]] = r["name"]

    def line(self, r):
        if r["k"] in self.names:
            yield to_shard(r["flag"], self.names[r["k"]])
        else:
            self.counter.add("part-not-found")


@query("""SELECT 'lines/' || l_returnflag AS what, count(*) AS n FROM lineitem JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey GROUP BY 1
 UNION ALL SELECT 'part-not-found', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
 UNION ALL SELECT 'map-input-parts', count(*) FROM part WHERE p_size <= 25 UNION ALL SELECT 'map-input-lines', count(*) FROM lineitem""")
def handler_counters_and_routes(spark, sf_dir):
    """A join by handlers that route records to shards of their choice and count misses."""
    p = Pipeline(spark, _folder(spark))
    parts = p.read("parts", table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))).with_mod_n(5, F.col("k"))
    lines = p.read("lines", table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit("lines/"), "l_returnflag").alias("flag"))).with_mod_n(5, F.col("k"))
    p.join("named", [parts.bind("name"), lines.bind("line")], _Names, "value string", (p.counter,), named=True).write("out")
    p.run()
    by_file = files.read_text(spark, f"{p.root}/out/lines/*.txt").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    written = by_file.groupBy(F.concat(F.lit("lines/"), F.regexp_extract(_last("file"), "(.*)[.]txt$", 1)).alias("what")).agg(F.sum("n").alias("n"))
    counts = [(k, n) for k, n in p.counters["out"].items() if k != "fn-writes"]
    return written.unionByName(spark.createDataFrame(counts, "what string, n bigint"))
