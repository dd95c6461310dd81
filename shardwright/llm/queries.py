"""The queries of the training-data operators and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, line_dedup, lm_score, mixing, packing, quality_rules, secrets, simhash, url_filter
from .common import cut, has_table, table


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """The line labeller, fitted on a bounded sample of the labelled documents; without labels, its prior."""
    if not has_table(spark, sf_dir, "labels"):
        return quality_rules.PRIOR
    return quality_rules.fit_on_labels(docs, table(spark, sf_dir, "labels"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_control_case(table(spark, sf_dir, "conversations"))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge_quality(docs, quality_model(spark, docs, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_lm(docs, lm_score.fit_lm(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_clusters(table(spark, sf_dir, "documents"))


# What SQL can say about operators that it cannot express: counts, sums and rules, for the driver's comparison.


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words and documents of each source, as the plan has them, and whether every document is passed once or twice."""
    docs = table(spark, sf_dir, "documents")
    plan = mixing.plan_mixture(docs).select("source", "tokens", F.col("docs").cast("bigint").alias("docs"))
    passed = mixing.mix_sources(docs).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("source").alias("s")).agg(F.count_if(F.col("n").between(1, 2)).alias("passed"))
    return plan.join(passed, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def packing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: words of each document over its pieces; bins beyond the capacity and bins that hold a cluster twice (none)."""
    p = cut(packing.pack(table(spark, sf_dir, "documents")))
    bad = p.groupBy("bin_id", "cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    full = p.groupBy("bin_id").agg(F.sum("n_words").alias("w")).agg(F.count_if(F.col("w") > 2048).alias("too_full"))
    return p.groupBy("doc_id").agg(F.sum("n_words").alias("n_words")).select("*", F.lit(bad.first()[0]).alias("twice"), F.lit(full.first()[0]).alias("too_full"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the counts that SQL can make."""
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), quality_rules.PRIOR).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: host, path, rule, and the rule's verdict."""
    j = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return j.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: groups of equal texts, and the components that each lies in (one)."""
    c = simhash.simhash_clusters(table(spark, sf_dir, "documents"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return c.join(d, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("component_id").alias("components")).where("copies > 1").drop("h")


def lm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the corpus's counts, by how many words occur so often."""
    return lm_score.word_counts(table(spark, sf_dir, "documents")).groupBy("c").agg(F.count(F.lit(1)).alias("words"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
VIEWS = {
    mixing_totals: f"SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS tokens, count(*) AS docs, count(DISTINCT doc_id) AS passed FROM documents GROUP BY source",
    packing_sums: f"SELECT doc_id, CAST(sum(len({_WORDS})) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS too_full FROM documents GROUP BY doc_id",
    quality_counts: f"""SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(length(array_to_string({_WORDS}, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents)""",
    url_rules: """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
 r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h), f AS (SELECT *, CASE
 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM r)
 SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM f""",
    simhash_copies: "SELECT min(doc_id) AS doc_id, count(*) AS copies, CAST(1 AS BIGINT) AS components FROM documents GROUP BY coalesce(text, '') HAVING count(*) > 1",
    lm_words: f"SELECT CAST(c AS BIGINT) AS c, count(*) AS words FROM (SELECT w, count(*) AS c FROM (SELECT translate(unnest({_WORDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY w) GROUP BY c",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_line_dedup, op4_hnsw, op5_url_filter, op6_mixing, op7_packing, op8_secret_scan, op9_lm_score, op10_simhash, *VIEWS)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.SQL, "op3_line_dedup": line_dedup.SQL} | {f.__name__: q for f, q in VIEWS.items()}
