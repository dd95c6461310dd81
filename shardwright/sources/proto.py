"""Protocol buffer records: descriptors to schemas, binary and JSON codecs, LST files that carry their descriptors.

The JVM of a plain Spark has no protobuf reader, so records are decoded by Arrow batches in Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lst
from .files import clean_json

try:
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    from google.protobuf.descriptor import FieldDescriptor as FD
except ImportError:  # the rest of the library works without it
    descriptor_pb2 = None

SET_KEY, TYPE_KEY = "__proto_set__", "__proto_type__"


class JsonError(ValueError):
    """JSON that does not fit the message."""


def message_class(file_set: bytes, type_name: str):
    """The class of a message from a serialized FileDescriptorSet."""
    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(file_set).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(type_name))


def _many(f) -> bool:
    return f.is_repeated if hasattr(f, "is_repeated") else f.label == FD.LABEL_REPEATED


def _is_map(f) -> bool:
    return f.message_type is not None and f.message_type.GetOptions().map_entry


def schema_of(descriptor, depth: int = 8) -> T.StructType:
    """The schema of a message: enums by name, unsigned 64 bits as DECIMAL(20,0), maps as maps; recursion ends at `depth`."""
    kinds = {FD.CPPTYPE_INT32: T.IntegerType, FD.CPPTYPE_UINT32: T.LongType, FD.CPPTYPE_INT64: T.LongType, FD.CPPTYPE_FLOAT: T.FloatType, FD.CPPTYPE_DOUBLE: T.DoubleType, FD.CPPTYPE_BOOL: T.BooleanType, FD.CPPTYPE_ENUM: T.StringType}

    def kind(f, left):
        if f.cpp_type == FD.CPPTYPE_MESSAGE:
            return schema_of(f.message_type, left - 1)
        if f.cpp_type == FD.CPPTYPE_UINT64:
            return T.DecimalType(20, 0)
        if f.cpp_type == FD.CPPTYPE_STRING:
            return T.BinaryType() if f.type == FD.TYPE_BYTES else T.StringType()
        return kinds[f.cpp_type]()

    out = T.StructType()
    for f in descriptor.fields:
        if f.cpp_type == FD.CPPTYPE_MESSAGE and not depth:
            continue
        if _is_map(f):
            k, v = (f.message_type.fields_by_name[n] for n in ("key", "value"))
            out.add(f.name, T.MapType(kind(k, depth), kind(v, depth)))
        else:
            out.add(f.name, T.ArrayType(kind(f, depth)) if _many(f) else kind(f, depth), not getattr(f, "is_required", False))
    return out


def to_row(m, schema: T.StructType) -> dict:
    """A message as a dict of the schema's fields; unset fields are None, unset repeated ones empty."""
    from decimal import Decimal

    def value(f, v, dtype):
        if f.cpp_type == FD.CPPTYPE_MESSAGE:
            return to_row(v, dtype)
        if f.cpp_type == FD.CPPTYPE_ENUM:
            e = f.enum_type.values_by_number.get(v)
            return e.name if e else str(v)
        return Decimal(v) if f.cpp_type == FD.CPPTYPE_UINT64 else v

    out = {}
    for name in schema.names:
        f, dtype = m.DESCRIPTOR.fields_by_name[name], schema[name].dataType
        if _is_map(f):
            own = f.message_type.fields_by_name["value"]
            out[name] = {k: value(own, v, dtype.valueType) for k, v in getattr(m, name).items()}
        elif _many(f):
            out[name] = [value(f, v, dtype.elementType) for v in getattr(m, name)]
        else:
            out[name] = value(f, getattr(m, name), dtype) if m.HasField(name) else None
    return out


def from_row(m, row: dict):
    """The inverse: fills a message from a dict."""
    for name, v in row.items():
        f = m.DESCRIPTOR.fields_by_name[name]
        if v is None:
            continue
        one = (lambda x, f=f: f.enum_type.values_by_name[x].number) if f.cpp_type == FD.CPPTYPE_ENUM else (lambda x, f=f: int(x) if f.cpp_type == FD.CPPTYPE_UINT64 else x)
        if _is_map(f):
            own = f.message_type.fields_by_name["value"]
            for k, x in dict(v).items():
                if own.cpp_type == FD.CPPTYPE_MESSAGE:
                    from_row(getattr(m, name)[k], x)
                else:
                    getattr(m, name)[k] = x
        elif _many(f):
            for x in v:
                if f.cpp_type == FD.CPPTYPE_MESSAGE:
                    from_row(getattr(m, name).add(), x)
                else:
                    getattr(m, name).append(one(x))
        elif f.cpp_type == FD.CPPTYPE_MESSAGE:
            getattr(m, name).SetInParent()
            from_row(getattr(m, name), v)
        else:
            setattr(m, name, one(v))
    return m


def decode(value: Column, file_set: bytes, type_name: str) -> Column:
    """Binary messages to structs; null where the bytes can't be read."""
    schema = schema_of(message_class(file_set, type_name).DESCRIPTOR)
    wrapped = T.StructType([T.StructField("record", schema)])

    @F.pandas_udf(wrapped)
    def run(s: pd.Series) -> pd.DataFrame:
        cls, out = message_class(file_set, type_name), []
        for b in s:
            try:
                out.append(None if b is None else to_row(cls.FromString(bytes(b)), schema))
            except Exception:  # noqa: BLE001  the library's own error type differs between its implementations
                out.append(None)
        return pd.DataFrame({"record": out})

    return run(value)["record"]


def encode(record: Column, file_set: bytes, type_name: str) -> Column:
    """Structs to binary messages."""

    @F.pandas_udf("binary")
    def run(s: pd.DataFrame) -> pd.Series:
        cls = message_class(file_set, type_name)
        return pd.Series([from_row(cls(), _plain(r)).SerializePartialToString() for r in s.to_dict("records")])

    return run(record)


def _plain(v):
    """Pandas' and numpy's values as Python's."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and getattr(v, "ndim", 0)):
        return [_plain(x) for x in v]
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


def message_to_json(m, rename: Callable[[str], str] = lambda n: n, enum_as_ints: bool = False, bool_as_int: bool = False) -> str:
    """Compact JSON, fields in order of declaration: unset optional and empty repeated fields are left out, required ones
    never; floats have 7 significant digits, doubles at most 9 decimals; a field renamed to "" is left out."""

    def scalar(f, v) -> str:
        if f.cpp_type == FD.CPPTYPE_MESSAGE:
            return obj(v)
        if f.cpp_type == FD.CPPTYPE_ENUM:
            return str(v) if enum_as_ints else json.dumps(f.enum_type.values_by_number[v].name)
        if f.cpp_type == FD.CPPTYPE_BOOL:
            return str(int(v)) if bool_as_int else str(v).lower()
        if f.cpp_type in (FD.CPPTYPE_FLOAT, FD.CPPTYPE_DOUBLE):
            if not math.isfinite(v):
                return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
            text = f"{v:.7g}" if f.cpp_type == FD.CPPTYPE_FLOAT else repr(round(v, 9))
            return text if any(c in text for c in ".en") else text + ".0"
        if f.cpp_type == FD.CPPTYPE_STRING:
            return json.dumps(v.decode("utf-8", "replace") if isinstance(v, bytes) else v, ensure_ascii=False)
        return str(v)

    def obj(m) -> str:
        parts = []
        for f in m.DESCRIPTOR.fields:
            name = rename(f.name)
            if not name:
                continue
            if _is_map(f):
                own = f.message_type.fields_by_name["value"]
                if getattr(m, f.name):
                    parts.append(f"{json.dumps(name)}:{{{','.join(f'{json.dumps(str(k))}:{scalar(own, v)}' for k, v in sorted(getattr(m, f.name).items()))}}}")
            elif _many(f):
                if len(getattr(m, f.name)):
                    parts.append(f"{json.dumps(name)}:[{','.join(scalar(f, v) for v in getattr(m, f.name))}]")
            elif m.HasField(f.name) or getattr(f, "is_required", False):
                parts.append(f"{json.dumps(name)}:{scalar(f, getattr(m, f.name))}")
        return "{" + ",".join(parts) + "}"

    return obj(m)


def json_to_message(text: str, m, skip_unknown: bool = True):
    """Fills a message from JSON: trailing commas and comments allowed, null clears a field, 0 and 1 are booleans (other
    numbers are not), integers widen, enums by name, unknown keys are skipped or an error."""
    try:
        data = json.loads(clean_json(text))
    except ValueError as e:
        raise JsonError(str(e)) from e
    if not isinstance(data, dict):
        raise JsonError("not an object")

    def scalar(f, v):
        t = f.cpp_type
        if t == FD.CPPTYPE_BOOL and (isinstance(v, bool) or v in (0, 1)) and not isinstance(v, (float, str)):
            return bool(v)
        if t == FD.CPPTYPE_ENUM and isinstance(v, str) and v in f.enum_type.values_by_name:
            return f.enum_type.values_by_name[v].number
        if t in (FD.CPPTYPE_FLOAT, FD.CPPTYPE_DOUBLE) and isinstance(v, (int, float)) and not isinstance(v, bool):
            return float(v)
        if t in (FD.CPPTYPE_INT32, FD.CPPTYPE_INT64, FD.CPPTYPE_UINT32, FD.CPPTYPE_UINT64) and isinstance(v, int) and not isinstance(v, bool):
            return v
        if t == FD.CPPTYPE_STRING and isinstance(v, str):
            return v.encode() if f.type == FD.TYPE_BYTES else v
        raise JsonError(f"{f.name}: {v!r}")

    def fill(m, data):
        for name, v in data.items():
            f = m.DESCRIPTOR.fields_by_name.get(name)
            if f is None:
                if not skip_unknown:
                    raise JsonError(f"unknown field {name}")
                continue
            try:
                if v is None:
                    m.ClearField(name)
                elif _is_map(f):
                    k, own = (f.message_type.fields_by_name[n] for n in ("key", "value"))
                    for x, y in v.items():
                        getattr(m, name)[x if k.cpp_type == FD.CPPTYPE_STRING else int(x)] = scalar(own, y)
                elif _many(f):
                    if not isinstance(v, list):
                        raise JsonError(f"{name}: not an array")
                    for x in v:
                        if f.cpp_type == FD.CPPTYPE_MESSAGE:
                            fill(getattr(m, name).add(), x)
                        else:
                            getattr(m, name).append(scalar(f, x))
                elif f.cpp_type == FD.CPPTYPE_MESSAGE:
                    if not isinstance(v, dict):
                        raise JsonError(f"{name}: not an object")
                    getattr(m, name).SetInParent()
                    fill(getattr(m, name), v)
                else:
                    setattr(m, name, scalar(f, v))
            except (TypeError, ValueError, AttributeError) as e:
                raise e if isinstance(e, JsonError) else JsonError(f"{name}: {e}") from e

    fill(m, data)
    return m


def to_json(value: Column, file_set: bytes, type_name: str, **options) -> Column:
    """Binary messages to JSON lines."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        cls = message_class(file_set, type_name)
        return s.map(lambda b: None if b is None else message_to_json(cls.FromString(bytes(b)), **options))

    return run(value)


def from_json(value: Column, file_set: bytes, type_name: str, skip_unknown: bool = True) -> Column:
    """JSON lines to binary messages; null where they don't fit."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        cls, out = message_class(file_set, type_name), []
        for text in s:
            try:
                out.append(None if text is None else json_to_message(text, cls(), skip_unknown).SerializePartialToString())
            except JsonError:
                out.append(None)
        return pd.Series(out)

    return run(value)


def read_proto_lst(spark: SparkSession, paths, mode: str = "FAILFAST") -> DataFrame:
    """record (struct), file, pos of LST files of messages; the type is what the first file says."""
    meta = {r.key: bytes(r.value) for r in lst.lst_metadata(spark, paths).where(F.col("key").isin(SET_KEY, TYPE_KEY)).limit(2).collect()}
    if set(meta) != {SET_KEY, TYPE_KEY}:
        raise lst.LstError("the files don't tell their message type")
    df = lst.read_lst(spark, paths, mode=mode)
    return df.withColumn("record", decode(F.col("record"), meta[SET_KEY], meta[TYPE_KEY].decode()))


def proto_meta(file_set: bytes, type_name: str) -> dict[str, bytes]:
    """The header entries that make an LST file of messages readable without its program."""
    return {SET_KEY: file_set, TYPE_KEY: type_name.encode()}
