"""Corpus-wide line de-duplication in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut

#: Rows of a table that may be sent whole to every executor; counted before it is. A row is three numbers.
BROADCAST_ROWS = 200_000
#: Pieces that the documents of one line are dealt into where the table of repeated lines is too large to be sent.
SALTS = 32


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines removed, all columns kept, and __lines, __dropped (long) added.

    Lines (split at \\n; null or empty text: one empty line) explode with their positions to 128-bit hashes of their
    keys; rows of one hash and document are gathered first and then the documents of each hash are counted, with partial
    counts before the shuffle.  Keys of at least `min_chars` code points in at least `min_docs` documents lose all their
    lines except in the largest id that holds them; the others are joined again by position.  Only hashes, ids and
    positions are shuffled for that; a text moves once, to meet the positions that it loses.  The repeated lines are
    sent to the executors if they were counted to be few; otherwise a line's documents are dealt into `SALTS` pieces: a
    line in a third of all documents is no hot group either way.  The work on one document grows with its lines.

    Rows repeating an id are one document, whatever their texts.  A null id counts for nothing and its text stays whole,
    as does a null text; an empty table gives no rows.  Columns of docs that bear the names of the added ones are replaced.
    """
    docs = docs.drop("__lines", "__dropped")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__d"), F.xxhash64(F.col(text_col)).alias("__t"))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("t"), F.split(text_col, "\n", -1).alias("ls"))
    # Most lines are settled by their length before they are trimmed and hashed.
    keys = known.select("d", "t", F.posexplode("ls").alias("pos", "x")).where(F.char_length("x") >= min_chars)
    keys = keys.select("d", "t", "pos", F.btrim("x", F.lit(BLANKS)).alias("x")).where(F.char_length("x") >= min_chars)
    keys = keys.select("d", "t", "pos", F.xxhash64(k := ascii_lower(F.col("x"))).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    # A place: the hash of the text (rows of one id may differ) and the line's number in it.
    pairs = cut(keys.groupBy("h1", "h2", "d").agg(F.collect_set(F.struct("t", "pos")).alias("places")))
    common = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    common = cut(common)
    if common.count() <= BROADCAST_ROWS:
        lost = pairs.join(F.broadcast(common), ["h1", "h2"])
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lost = pairs.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    lost = lost.where("d <> keeper").select("d", F.explode("places").alias("p"))
    lost = lost.groupBy(F.col("d").alias("__ld"), F.col("p.t").alias("__lt")).agg(F.collect_set("p.pos").alias("__lost"))
    out = rows.join(lost, (F.col("__d") == F.col("__ld")) & (F.col("__t") == F.col("__lt")), "left")
    out = out.withColumn("__ls", F.split(F.col(f"__row.`{text_col}`"), "\n", -1))
    n = F.when(F.col("__ls").isNull(), 1).otherwise(F.size("__ls"))
    # array_except goes through a hash set and get() by index: both are linear in the lines.
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__ls") - 1), F.col("__lost")), lambda i: F.get("__ls", i))
    text = F.when(F.col("__lost").isNull(), F.col(f"__row.`{text_col}`")).otherwise(F.array_join(stay, "\n"))
    kept = [(text if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]
    return out.select(*kept, n.cast("long").alias("__lines"), F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long").alias("__dropped"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 (of the remaining text)."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
