"""Text, CSV and JSON sources."""

from __future__ import annotations

import bz2
import functools
import os
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileSpec:
    """One input of a reader: a glob and what is to be attached to each of its records."""

    glob: str
    i64: int | None = None
    text: str | None = None


def read_text(spark: SparkSession, inputs: str | Sequence[str | FileSpec], skip_header: int = 0, with_position: bool = False) -> DataFrame:
    """value, file, meta (struct of i64 and text), and with positions also pos (0-based in its file, after the header).

    Lines end at \\n only; one \\r before it is stripped, others are data.  Inputs are united as they are listed, a file
    listed twice is read twice; a path that ends in ** takes in all files below it.  Compression goes by the file's
    extension; read_any() looks at the bytes.  Large files are read in splits, also with positions and headers: lines
    are numbered inside their split, and the lines of the splits before it are counted in a pass of its own.
    """
    specs = [s if isinstance(s, FileSpec) else FileSpec(s) for s in ([inputs] if isinstance(inputs, str) else inputs)]
    parts = []
    for s in specs:
        path = os.path.expanduser(s.glob)
        recursive = path.endswith("**")
        reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
        lines = reader.option("lineSep", "\n").text(path[:-2] if recursive else path)
        df = _numbered(lines, skip_header) if skip_header or with_position else lines.select("value", F.col("_metadata.file_path").alias("file"))
        df = df.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
        parts.append(df.withColumn("meta", F.struct(F.lit(s.i64).cast("bigint").alias("i64"), F.lit(s.text).cast("string").alias("text"))))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out if with_position or not skip_header else out.drop("pos")


def _numbered(lines: DataFrame, skip: int) -> DataFrame:
    """value, file, pos of text lines: the number in the split plus the lines of the file's earlier splits; the first `skip` of each file go."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, n = None, 0
        for b in batches:
            files, blocks = b.column(1), b.column(2)
            new = np.zeros(b.num_rows, bool)
            if b.num_rows:
                new[0] = (files[0].as_py(), blocks[0].as_py()) != at
                same = np.asarray(pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False), bool)
                new[1:] = ~same
                at = files[b.num_rows - 1].as_py(), blocks[b.num_rows - 1].as_py()
            rows = np.arange(b.num_rows)
            starts = np.maximum.accumulate(np.where(new, rows, -1))
            pos = np.where(starts < 0, n + rows, rows - starts)
            n = int(pos[-1]) + 1 if len(pos) else n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos.astype(np.int64))], ["value", "file", "block", "pos"])

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    sizes = lines.select(*place).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = lines.select("value", *place).mapInArrow(run, "value string, file string, block bigint, pos bigint")
    out = rows.join(sizes, ["file", "block"], "left")
    # Both passes cut files alike; should a session's settings change in between, that is an error and not a wrong number.
    first = F.coalesce("first", F.raise_error(F.lit("the splits of a file changed between two passes over it")).cast("bigint"))
    return out.withColumn("pos", F.col("pos") + first - skip).where("pos >= 0").select("value", "file", "pos")


def decompress(data: bytes) -> bytes:
    """The content of a file by its first bytes: zstd, bzip2, gzip, zlib or none."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import io

        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:2] == b"\x1f\x8b":
        out = b""
        while data:
            d = zlib.decompressobj(31)
            out += d.decompress(data) + d.flush()
            data = d.unused_data
        return out
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompress(data)
    return data


def read_any(spark: SparkSession, paths) -> DataFrame:
    """value, file, pos: the lines of text files whatever their compression or extension. One file is one unit of work."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = decompress(content).split(b"\n")
                if lines[-1] == b"":
                    lines.pop()
                for k in range(0, len(lines), 20_000):
                    some = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[k : k + 20_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([path] * len(some), pa.string()), pa.array(range(k, k + len(some)), pa.int64())], ["value", "file", "pos"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "value string, file string, pos bigint")


def read_csv(spark: SparkSession, paths, columns: int | None = None, delimiter: str = ",", skip_header: int = 0) -> DataFrame:
    """fields (array of strings), file: blank lines are skipped, fields follow functions.text.csv_fields."""
    from ..functions.text import csv_fields

    df = read_text(spark, paths, skip_header).withColumn("value", F.trim("value")).where("value <> ''")
    df = df.select(csv_fields(F.col("value"), delimiter).alias("fields"), "file")
    return df.where(F.size("fields") == columns) if columns else df


def read_csv_rows(spark: SparkSession, paths, delimiter: str = ",", header: bool = False) -> DataFrame:
    """fields (array of strings), file, pos (0-based number of the row): rows whose quoted fields may hold line feeds.

    A row ends at a line feed outside quotes; a doubled quote inside quotes is one quote; a carriage return before the
    end goes.  Where a row begins depends on all quotes before it, so a file is one unit of work; it is read line by line.
    Blank rows are skipped; with header the first row of each file goes.
    """

    def run(batches):
        import csv
        import io

        import pyarrow as pa

        csv.field_size_limit((1 << 31) - 1)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = (r for r in csv.reader(io.TextIOWrapper(io.BytesIO(decompress(content)), "utf-8", "replace", newline=""), delimiter=delimiter) if any(r) or len(r) > 1)
                if header:
                    next(rows, None)
                held, first = [], 0
                for r in rows:
                    held.append(r)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string())), pa.array([path] * len(held)), pa.array(range(first, first + len(held)), pa.int64())], ["fields", "file", "pos"])
                        held, first = [], first + len(held)
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string())), pa.array([path] * len(held)), pa.array(range(first, first + len(held)), pa.int64())], ["fields", "file", "pos"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "fields array<string>, file string, pos bigint")


_STRING = r'"(?:[^"\\]|\\.)*"'


def clean_json(text: str) -> str:
    """JSON without comments and without commas before a closing bracket; strings stay as they are."""
    text = re.sub(rf"({_STRING})|/\*.*?\*/|//[^\n]*", lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(rf"({_STRING})|,(\s*[}}\]])", lambda m: m[1] or m[2], text)


def parse_json(df: DataFrame, schema: str | None = None, value: str = "value") -> DataFrame:
    """df with json (VARIANT, or by the schema); trailing commas and comments are allowed, bad rows have null.

    Rows that the JVM can read are not touched by Python: only the others are cleaned and tried again.
    """
    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None else clean_json(v))

    first = F.try_parse_json(value)
    text = F.when(first.isNotNull() | F.col(value).isNull(), F.col(value)).otherwise(clean(F.when(first.isNull(), F.col(value))))
    df = df.withColumn("__json", text)
    made = F.from_json("__json", schema) if schema else F.try_parse_json("__json")
    return df.withColumn("json", made).drop("__json")


def json_has(value, member: str):
    """Whether a JSON object has a member, also where it is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), member), F.lit(False))


def wet_pages(df: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """(file, uri, body) of the conversion records of web text archives, given as whole files: headers dropped, characters
    other than letters, digits, punctuation and white space replaced by spaces."""
    parts = df.select(file, F.explode(F.split(text, r"(?m)^WARC/1\.0\r?$")).alias("r")).where(F.col("r").rlike(r"WARC-Type:\s*conversion"))
    uri = F.regexp_extract("r", r"WARC-Target-URI:\s*(\S+)", 1)
    body = F.regexp_replace(F.regexp_extract("r", r"(?s)\r?\n\r?\n(.*)$", 1), r"[^\w\p{L}\p{P}\s]", " ")
    return parts.select(F.col(file).alias("file"), uri.alias("uri"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("body"))


def read_wet(spark: SparkSession, paths, mark: str = "WARC/1.0\r\n") -> DataFrame:
    """(file, uri, body, bad_lines) of the conversion records of web text archives, read record by record.

    A record is what lies between two version lines (`mark`), so that no archive is held whole and plain ones are split.
    Lines that are not UTF-8 are dropped and counted; characters other than letters, digits, punctuation and white
    space become spaces.
    """
    r = spark.read.option("lineSep", mark).text(paths).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").contains("WARC-Type: conversion"))
    at = F.locate("\r\n\r\n", F.col("value"))
    r = r.where(at > 0).select("file", F.expr("substring(value, 1, locate('\\r\\n\\r\\n', value))").alias("head"), F.split(F.expr("substring(value, locate('\\r\\n\\r\\n', value) + 4)"), "\n").alias("ls"))
    r = r.where(F.col("head").rlike(r"(?m)^WARC-Type: *conversion"))
    good = F.filter("ls", F.is_valid_utf8)
    body = F.regexp_replace(F.array_join(good, "\n"), r"[^\w\p{L}\p{P}\s]", " ")
    uri = F.regexp_extract("head", r"WARC-Target-URI:\s*(\S+)", 1)
    return r.select("file", uri.alias("uri"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("body"), (F.size("ls") - F.size(good)).cast("bigint").alias("bad_lines"))
