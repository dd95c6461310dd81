"""Looking into nested records: projection to CSV, sizes by field, schema export, samples, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprint
from ..plang.compiler import member


def csv_project(df: DataFrame, paths: list[str], null: str = "\\N", aggregate_repeated: bool = False, delimiter: str = ",") -> DataFrame:
    """One column `line`: the fields of each record as CSV.

    Unset fields print as `null`.  A repeated field gives a line for each element; several give all combinations,
    unless they share a repeated ancestor, whose elements then go together; an empty one gives no line.  With
    aggregate_repeated a repeated leaf is one cell of its elements.  Names may be tags: the field's number from 1.
    Each distinct repeated ancestor is one explode, so nothing is multiplied more than the result asks for.
    """
    schema, cells, done = df.schema, [], {}
    out = df
    for path in paths:
        col, dtype, at = None, schema, ()
        names = path.split(".")
        for k, name in enumerate(names):
            if name.isdigit():
                name = dtype.names[int(name) - 1]
            if not isinstance(dtype, T.StructType) or name not in dtype.names:
                raise ValueError(f"no field {name} in {path}")
            col, dtype, at = (F.col(f"`{name}`") if col is None else col[name]), dtype[name].dataType, (*at, name)
            if isinstance(dtype, T.ArrayType):
                leaf = k == len(names) - 1
                if leaf and aggregate_repeated:
                    col = F.when(F.size(col) > 0, F.concat(F.lit('"'), F.array_join(F.transform(col, lambda x: x.cast("string")), ","), F.lit('"')))
                    dtype = T.StringType()
                    continue
                if at not in done:
                    done[at] = f"__x{len(done)}"
                    out = out.withColumn(done[at], F.explode(col))
                col, dtype = F.col(done[at]), dtype.elementType
        cells.append(F.coalesce(col.cast("string"), F.lit(null)))
    line = F.concat_ws(delimiter, *cells)
    return out.select(line.alias("line")).where(~F.col("line").rlike(f"^[{delimiter}]*$"))


_WIDTH = {T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.ShortType: 2, T.ByteType: 1, T.BooleanType: 1, T.DecimalType: 16}


def _size(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col).cast("bigint"), F.lit(0).cast("bigint"))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.aggregate(col, F.lit(0).cast("bigint"), lambda s, x: s + _size(x, dtype.elementType)), F.lit(0).cast("bigint"))
    if isinstance(dtype, T.StructType):
        return sum((_size(col[f.name], f.dataType) for f in dtype.fields), F.lit(0).cast("bigint"))
    if isinstance(dtype, T.MapType):
        return _size(F.map_keys(col), T.ArrayType(dtype.keyType)) + _size(F.map_values(col), T.ArrayType(dtype.valueType))
    return F.when(col.isNull(), 0).otherwise(_WIDTH.get(type(dtype), 8)).cast("bigint")


def field_sizes(df: DataFrame) -> DataFrame:
    """(path, bytes): bytes of each dotted field over all records, strings by their length, others by their width; a parent
    is the sum of its children; fields without bytes are left out.  One aggregation, whatever the number of fields."""
    leaves: dict[str, Column] = {}

    def visit(path: str, col: Column, dtype: T.DataType):
        leaves[path] = _size(col, dtype)
        inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
        if isinstance(inner, T.StructType):
            for f in inner.fields:
                child = F.transform(col, member(f.name)) if isinstance(dtype, T.ArrayType) else col[f.name]
                kind = T.ArrayType(f.dataType) if isinstance(dtype, T.ArrayType) else f.dataType
                if isinstance(kind, T.ArrayType) and isinstance(f.dataType, T.ArrayType) and isinstance(dtype, T.ArrayType):
                    child, kind = F.flatten(F.filter(child, lambda x: x.isNotNull())), f.dataType
                visit(f"{path}.{f.name}", child, kind)

    for f in df.schema.fields:
        visit(f.name, F.col(f"`{f.name}`"), f.dataType)
    one = df.agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(leaves.values())))
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"c{i}").alias("bytes")) for i, p in enumerate(leaves)))
    return one.select(F.explode(pairs).alias("x")).select("x.path", "x.bytes").where("bytes > 0")


_KIND = {T.StringType: "STRING", T.BinaryType: "STRING", T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT", T.DoubleType: "FLOAT"}


def table_schema(schema: T.StructType, rename=lambda name: name, retype=lambda field: None) -> list[dict]:
    """A schema as the list of dicts that table loaders take: name, type, mode, and fields of records."""
    out = []
    for f in schema.fields:
        many = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if many else f.dataType
        d = {"name": rename(f.name), "type": retype(f) or ("RECORD" if isinstance(kind, T.StructType) else _KIND.get(type(kind), "INTEGER"))}
        if many or not f.nullable:
            d["mode"] = "REPEATED" if many else "REQUIRED"
        if isinstance(kind, T.StructType):
            d["fields"] = table_schema(kind, rename, retype)
        out.append(d)
    return out


def sample_by_key(df: DataFrame, key: str, factor: int) -> DataFrame:
    """Rows whose key's fingerprint (lower 32 bits) is divisible by factor: the same keys in every table."""
    return df.where(F.pmod(fingerprint(F.col(key)).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(factor)) == 0)


def print_text(c: Column, omit_blobs: bool = False) -> Column:
    """A text for a console: control characters escaped; with omit_blobs, long ones that hold any are named only."""
    shown = c
    for raw, name in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        shown = F.replace(shown, F.lit(raw), F.lit(name))
    return F.when((F.octet_length(c) > 100) & c.rlike(r"[\x00-\x08\x0e-\x1f]"), F.lit("Not work safe!")).otherwise(shown) if omit_blobs else shown
