"""A predicate's tree to one Column over a DataFrame's schema.

Comparisons are existential: true if any value of the left side and any of the right side agree, so a path through
repeated fields compiles to an array and `exists`.  There is no third truth value: unset scalars compare as their
default, empty repeated fields make a comparison false.  Everything compiles to built-in expressions, so scalar
comparisons reach the scan as pushed filters where the field can't be null (Catalyst's rules), and arrays stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parser import PredicateError, parse

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_EPS = 32 * 2.0**-52


@dataclass
class Value:
    """A compiled scalar: a column, or an array of values; kind: int, double, string or enum."""

    col: Column
    kind: str
    many: bool = False
    names: dict | None = None
    literal: object = None


def compile_predicate(text: str, schema: T.StructType, enums: dict[str, dict[str, int]] | None = None, defaults: dict[str, object] | None = None) -> Column:
    """The predicate as a boolean Column that is never null.

    enums: {path: {name: number}} for string fields that hold enum names; defaults: {path: value of the unset field}
    (0, "", false and the first enum name otherwise).
    """
    return _Compiler(schema, enums or {}, defaults or {}).top(parse(text))


class _Compiler:
    def __init__(self, schema, enums, defaults):
        self.schema, self.enums, self.defaults = schema, enums, defaults

    # -- truth values

    def top(self, tree) -> Column:
        if tree[0] == "def":
            v, many = self.presence(tree[1])
            return F.coalesce(F.element_at(v, -1), F.lit(False)) if many else v
        return self.truth(tree)

    def truth(self, tree) -> Column:
        if tree[0] == "and":
            return self.truth(tree[1]) & self.truth(tree[2])
        if tree[0] == "or":
            return self.truth(tree[1]) | self.truth(tree[2])
        if tree[0] == "not":
            if tree[1][0] == "def":  # any parent in which it is not set
                v, many = self.presence(tree[1][1])
                return F.coalesce(F.exists(v, lambda x: ~x), F.lit(False)) if many else ~v
            return ~self.truth(tree[1])
        if tree[0] == "def":
            v, many = self.presence(tree[1])
            return F.coalesce(F.exists(v, lambda x: x), F.lit(False)) if many else v
        _, op, left, right = tree
        a, b = self.scalar(left), self.scalar(right)
        if op == "!=":
            return ~self.compare("=", a, b)
        if op in (">", ">="):
            a, b, op = b, a, op.replace(">", "<")
        return self.compare(op, a, b)

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if op == "rlike":
            if a.kind != "string" or b.kind != "string":
                raise PredicateError("RLIKE compares strings")
            if b.literal is None:
                raise PredicateError("the pattern of RLIKE is a literal")
            test = lambda x, y: x.rlike(rf"\A(?:{b.literal})\z")
        elif op == "=":
            test = self.equality(a, b)
        else:
            if {a.kind, b.kind} - {"int", "double"}:
                raise PredicateError(f"{op} compares numbers")
            test = (lambda x, y: x < y) if op == "<" else (lambda x, y, eq=self.equality(a, b): (x < y) | eq(x, y))
        if a.many and b.many:
            hit = F.exists(a.col, lambda x: F.exists(b.col, lambda y: test(x, y)))
        elif a.many:
            hit = F.exists(a.col, lambda x: test(x, b.col))
        elif b.many:
            hit = F.exists(b.col, lambda y: test(a.col, y))
        else:
            hit = test(a.col, b.col)
        return F.coalesce(hit, F.lit(False))

    def equality(self, a: Value, b: Value):
        if "enum" in (a.kind, b.kind):
            e, other = (a, b) if a.kind == "enum" else (b, a)
            if other.kind == "int" and other.literal is not None:
                name = next((k for k, v in e.names.items() if v == other.literal), None)
                if name is None:
                    return lambda x, y: F.lit(False)
                return (lambda x, y: x == name) if e is a else (lambda x, y: y == name)
            if other.kind not in ("string", "enum"):
                raise PredicateError("an enum compares with its number or name")
            return lambda x, y: x == y
        if "string" in (a.kind, b.kind):
            if a.kind != b.kind:
                raise PredicateError("a string compares with a string")
            return lambda x, y: x == y
        return almost_equal if "double" in (a.kind, b.kind) else lambda x, y: x == y

    # -- values

    def scalar(self, tree) -> Value:
        kind, v = tree[0], tree[1]
        if kind == "int":
            signed = v - (1 << 64) if v >= 1 << 63 else v  # large unsigned literals count as signed
            return Value(F.lit(signed).cast("bigint"), "int", literal=v)
        if kind == "double":
            return Value(F.lit(float(v)), "double", literal=v)
        if kind == "str":
            return Value(F.lit(v), "string", literal=v)
        if kind == "call":
            if v != "hash" or len(tree[2]) != 1:
                raise PredicateError(f"no function {v} with {len(tree[2])} arguments")
            from ..functions.hashing import murmur3_32

            arg = self.scalar(tree[2][0])
            if arg.kind != "string" or arg.many:
                raise PredicateError("hash takes one string")
            return Value(murmur3_32(arg.col, 16785407), "int")
        col, dtype, many, _ = self.walk(v)
        if isinstance(dtype, T.ArrayType):
            if not isinstance(dtype.elementType, _INTS):
                raise PredicateError(f"{v}: a repeated leaf of this type")
            col = F.flatten(F.filter(col, lambda x: x.isNotNull())) if many else F.coalesce(col, F.array().cast(dtype))
            many, dtype = True, dtype.elementType
        if v in self.enums:
            value_kind, default = "enum", self.defaults.get(v, min(self.enums[v], key=self.enums[v].get))
        elif isinstance(dtype, _INTS):
            value_kind, default = "int", int(self.defaults.get(v, 0))
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            value_kind, default = "double", float(self.defaults.get(v, 0.0))
        elif isinstance(dtype, T.DecimalType) and dtype.scale > 0:
            value_kind, default = "double", float(self.defaults.get(v, 0.0))
        elif isinstance(dtype, T.DecimalType):  # unsigned 64-bit numbers, which count as signed
            value_kind, default = "int", int(self.defaults.get(v, 0))
            whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
            wrap = lambda x: F.when(x >= F.lit(str(1 << 63)).cast("decimal(38,0)"), x.cast("decimal(38,0)") - whole).otherwise(x.cast("decimal(38,0)"))
            col = F.transform(col, wrap) if many else wrap(col)
        elif isinstance(dtype, T.StringType):
            value_kind, default = "string", self.defaults.get(v, "")
        else:
            raise PredicateError(f"{v}: not a scalar field")
        to = {"int": "bigint", "double": "double"}.get(value_kind)
        fill = lambda x: F.coalesce(x.cast(to) if to else x, F.lit(default))
        return Value(F.transform(col, fill) if many else fill(col), value_kind, many, self.enums.get(v))

    def presence(self, path: str) -> tuple[Column, bool]:
        """Whether the field is set: one boolean, or an array of one for each parent."""
        col, dtype, many, _ = self.walk(path)
        there = (lambda x: F.coalesce(F.size(x) > 0, F.lit(False))) if isinstance(dtype, (T.ArrayType, T.MapType)) else (lambda x: x.isNotNull())
        return (F.transform(col, there), True) if many else (there(col), False)

    def walk(self, path: str):
        """(column, type, whether it is an array over the parents, names) of a dotted path; arrays of messages flatten."""
        col, dtype, many = None, self.schema, False
        for name in path.split("."):
            if isinstance(dtype, T.ArrayType):  # into the messages of a repeated field
                inner = F.coalesce(col, F.array().cast(dtype)) if not many else F.flatten(F.transform(col, _or_empty(dtype)))
                col, dtype, many = inner, dtype.elementType, True
            if not isinstance(dtype, T.StructType) or name not in dtype.names:
                raise PredicateError(f"no field {name} in {path}")
            col = F.col(f"`{name}`") if col is None else F.transform(col, member(name)) if many else col[name]
            dtype = dtype[name].dataType
        return col, dtype, many, path


def member(name: str):
    return lambda x: x[name]


def _or_empty(dtype):
    return lambda x: F.coalesce(x, F.array().cast(dtype))


def almost_equal(x: Column, y: Column, eps: float = _EPS) -> Column:
    """Equal doubles up to an absolute or relative error of 32 units in the last place of 1."""
    x, y = x.cast("double"), y.cast("double")
    gap = F.abs(x - y)
    return (x == y) | ((gap < float("inf")) & ((gap <= eps) | (gap <= eps * F.greatest(F.abs(x), F.abs(y)))))
