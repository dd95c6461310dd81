"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import LOWER, UPPER, cut

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host words whose URLs are labelled block for training (they decide nothing themselves).
LABEL_WORDS = ("spam", "casino", "pills", "adult", "bets", "ads-track", "porn", "xxx", "viagra", "phish")
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "dots", "suffix_rate", "domain_rate")


def split_url(urls: DataFrame) -> DataFrame:
    """urls (with a column url) with host (A-Z lower-cased) and path; null or without ://, both are empty."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    u = urls.withColumn("__rest", F.coalesce(rest, F.lit("")))
    u = u.withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER))
    return u.withColumn("path", F.regexp_extract(F.expr("substring(__rest, char_length(host) + 1)"), r"^[^?#]*", 0)).drop("__rest")


def rule_column(rules=RULES):
    """The text (host and path) of the longest rule that fits, else null; of equally long ones that with the longer host."""
    hit = F.lit(None).cast("string")
    for _, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        hit = F.when(fits, F.lit(host + path)).otherwise(hit)
    return hit


def _entropy(c):
    """Bits per character: one count for each distinct character."""
    n = F.char_length(c).cast("double")
    parts = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(x == "", F.lit(0.0)).otherwise((n - F.char_length(F.replace(c, x, F.lit("")))) / n))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def with_features(urls: DataFrame, stats: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features; stats (suffix, kind, rate) is at most as long as the labelled sample and is broadcast."""
    u = F.coalesce("url", F.lit(""))
    df = urls.withColumn("length", F.char_length(u).cast("double")).withColumn("host_length", F.char_length("host").cast("double"))
    df = df.withColumn("depth", F.regexp_count("path", F.lit("[^/]+")).cast("double"))
    df = df.withColumn("digit_ratio", F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.char_length(u), F.lit(1)))
    df = df.withColumn("entropy", F.when(F.char_length(u) > 0, _entropy(u)).otherwise(0.0))
    df = df.withColumn("params", F.regexp_count(u, F.lit(r"[?&][^?&#=]+=")).cast("double"))
    df = df.withColumn("hyphens", F.regexp_count("host", F.lit("-")).cast("double")).withColumn("dots", F.regexp_count("host", F.lit(r"\.")).cast("double"))
    df = df.withColumn("__suffix", F.substring_index("host", ".", -1)).withColumn("__domain", F.concat(F.substring_index("host", ".", -2), F.regexp_extract("path", "^/[^/]*", 0)))
    for kind in ("suffix", "domain"):
        s = stats.where(F.col("kind") == kind).select(F.col("suffix").alias(f"__k_{kind}"), F.col("rate").alias(f"{kind}_rate"))
        df = df.join(F.broadcast(s), F.col(f"__{kind}") == F.col(f"__k_{kind}"), "left").drop(f"__k_{kind}")
    return df.fillna(0.5, ["suffix_rate", "domain_rate"])


def labels_of(urls: DataFrame, rules=RULES, words=LABEL_WORDS) -> DataFrame:
    """(url, label) of the urls (url, host, path) that can be labelled without a table of labels.

    Block: hosts with one of `words`.  Allow: what a rule allows, and hosts without such a word that no rule fits
    (presumed clean).  URLs that a rule blocks are policy and teach nothing.
    """
    rule = rule_column(rules)
    allowed = [h + p for v, h, p in rules if v == "allow"]
    label = F.when(F.col("host").rlike("|".join(words)), 1).when(rule.isNull() | rule.isin(allowed), 0)
    return urls.where("host <> ''").select("url", label.alias("label")).where("label is not null")


def labelled_sample(labelled: DataFrame, most_rows: int = 6000) -> DataFrame:
    """(url, host, path, label) of at most `most_rows` different URLs of labelled (url, label), half of each label, first by a hash of the URL.

    Rows are counted first, and only those whose hash lies below four times the share that is needed are made distinct, so that
    no more than a few times the sample is shuffled.  A URL with both labels counts once for each; null URLs and labels are dropped.
    """
    known = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.shiftrightunsigned(F.xxhash64("url"), 1) / F.lit(float(1 << 63))
    below = F.when(F.col("label") == 1, 2.0 * most_rows / max(sizes.get(1, 0), 1)).otherwise(2.0 * most_rows / max(sizes.get(0, 0), 1))
    some = known.where(unit < below).select("url", "label").distinct()
    some = cut(some)
    parts = [some.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(most_rows // 2) for v in (0, 1)]
    return cut(split_url(parts[0].unionByName(parts[1])).select("url", "host", "path", "label"))


def fit_urls(labelled: DataFrame) -> tuple[dict, DataFrame]:
    """Trees and suffix statistics from labelled URLs (url, host, path, label 0/1), which the caller has bounded.

    Half of the sample gives the suffix statistics and the other half the trees, so that the trees see rates of URLs
    that are not their own.
    """
    spark = labelled.sparkSession
    rows = labelled.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.concat(F.substring_index("host", ".", -2), F.regexp_extract("path", "^/[^/]*", 0)))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)))
    both = rows.where("half = 0").select(F.explode(F.array(F.struct(F.lit("suffix").alias("kind"), F.col("suffix").alias("suffix")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("suffix")))).alias("x"), "label")
    found = both.groupBy("x.kind", "x.suffix").agg(((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("rate")).collect()
    stats = spark.createDataFrame([(r.kind, r.suffix, r.rate) for r in found], "kind string, suffix string, rate double")
    got = with_features(rows.where("half = 1").select("url", "host", "path", "label"), stats).select(*FEATURES, "label").collect()
    data = sorted(tuple(r) for r in got)
    return trees.boosted([r[:-1] for r in data], [r[-1] for r in data]), stats


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most_labelled: int = 6000) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (the trees' log-odds of block) for each row of pages.

    The longest fitting rule decides; the trees decide where none fits.  The trees are fitted on a bounded sample of different
    labelled URLs (labelled: url, label 1 to block; without it labels_of() the pages themselves); features and scores are expressions over the scan, without a shuffle of pages.  Null and
    malformed URLs have empty host and path and get the trees' verdict; ids may be null or repeated; an empty table gives
    no rows; without labelled rows every undecided URL is allowed.
    """
    urls = split_url(pages.select("page_id", "url"))
    model, stats = fit_urls(labelled_sample(labels_of(urls, rules) if labelled is None else labelled, most_labelled))
    df = with_features(urls, stats)
    df = df.withColumn("rule", rule_column(rules)).withColumn("score", trees.score(model, [F.col(c) for c in FEATURES]) if model["trees"] else F.lit(-1.0))
    blocks = [h + p for v, h, p in rules if v == "block"]
    verdict = F.when(F.col("rule").isin(blocks), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("score") > 0, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
