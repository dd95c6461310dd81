"""A corpus pipeline of five of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shardwright.llm import line_dedup, mixing, packing, quality_rules, queries, simhash
from shardwright.llm.common import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too few words, repeats, or mostly boilerplate lines.

    Null and empty texts are rejected; rows are judged one by one, whatever their id; columns stay as they are; no rows give no rows.
    """
    return quality_rules.quality_filter(docs, queries.quality_model(spark, docs, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go, but for the largest id that holds them; n_chars follows the text.

    A null id counts for nothing and its text stays whole; rows repeating an id are one document; a document may lose all its
    lines and stays with an empty text; other columns stay as they are; no rows give no rows.
    """
    from pyspark.sql import functions as F

    out = line_dedup.line_dedup(docs)
    return out.select(*(F.when(F.col("__dropped") > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: the smallest id.

    Texts without words are equal and so one group; a null id stays; rows repeating an id stay or go together; no rows give no rows.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again as often as its source's weight asks for.

    A null source is a source, a null text has no words, null ids share a place; no rows give no rows.
    """
    return mixing.mix_sources(docs).select(*(f"`{c}`" for c in docs.columns))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins: one row for each piece; null and empty texts take a place of size 0; no rows give no rows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("bins", bins)]

#: A fitted labeller, fingerprints and best-fit search are not SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read again.

    A stage's table goes once the next one is written: only the last stays, for the caller to read.
    """
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}_{name}")
        docs = spark.read.parquet(f"{at}/{k}_{name}")
        if k:
            remove(spark, f"{at}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
