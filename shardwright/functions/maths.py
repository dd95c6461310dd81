"""Numeric, vector, matrix and geographic functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plang.compiler import almost_equal

__all__ = ["almost_equal"]


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))


def sign(x: Column) -> Column:
    """-1, 0 or 1 as int; NaN has no sign and gives 0."""
    return F.when(x.isNull(), F.lit(None)).when((x > 0) & ~F.isnan(x.cast("double")), 1).when(x < 0, -1).otherwise(0).cast("int")


def max_nan(x: Column, y: Column) -> Column:
    """The larger; NaN if either is."""
    return F.greatest(x, y)


def min_nan(x: Column, y: Column) -> Column:
    """The smaller; NaN if either is (Spark's least() takes NaN as the largest)."""
    return F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).otherwise(F.least(x, y))


def abs_diff(x: Column, y: Column) -> Column:
    return F.when(x > y, x - y).otherwise(y - x)


def round_half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def harmonic(n: Column) -> Column:
    """The n-th harmonic number by Euler and Maclaurin: ln n + gamma + 1/2n - 1/12n^2 + 1/120n^4."""
    n = n.cast("double")
    return F.log(n) + F.lit(0.5772156649015329) + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n, 4))


def within_margin(x: Column, y: Column, margin) -> Column:
    return F.abs(x - y) <= margin


def within_fraction(x: Column, y: Column, fraction) -> Column:
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return finite & (F.abs(x - y) <= F.lit(fraction) * F.greatest(F.abs(x), F.abs(y)))


def log2_floor(n: Column) -> Column:
    """Index of the highest set bit of a positive number, -1 for 0; exact for all 63 bits."""
    return (F.length(F.bin(n)) - 1 - F.when(n == 0, 1).otherwise(0)).cast("int")


def lowest_bit(n: Column) -> Column:
    return (F.length(F.bin(n.bitwiseAND(-n))) - 1).cast("int")


def next_power_of_2(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), log2_floor(n - 1) + 1).cast("bigint"))


def round_off_bits(x: Column, bits: int) -> Column:
    """A double rounded to 52 - bits bits of mantissa: scaled by its exponent, half to even."""
    e = F.floor(F.log2(F.abs(x)))
    unit = F.pow(F.lit(2.0), e - 52 + bits)
    return F.when(x == 0, x).otherwise(F.rint(x / unit) * unit)


def shortest(c: Column, single: bool = False) -> Column:
    """The shorter of two printf formats that reads back as the same number: 15 or 17 digits, for floats 6 or 8."""
    import numpy as np

    few, most = (6, 8) if single else (15, 17)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        kind = np.float32 if single else np.float64
        return s.map(lambda v: None if v is None or v is pd.NA else next((t for t in (f"{v:.{few}g}",) if kind(t) == kind(v)), f"{v:.{most}g}"))

    return run(c)


def to_decimal(c: Column) -> Column:
    """(significand, exponent, digits) of a double: the shortest decimal that reads back as it."""

    @F.pandas_udf("significand bigint, exponent int, digits int")
    def run(s: pd.Series) -> pd.DataFrame:
        from decimal import Decimal

        parts = [Decimal(repr(float(v))).normalize().as_tuple() for v in s]
        rows = [((-1 if t.sign else 1) * int("".join(map(str, t.digits))), t.exponent, len(t.digits)) for t in parts]
        return pd.DataFrame(rows, columns=["significand", "exponent", "digits"])

    return run(c)


# Vectors are arrays of doubles.

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * (k if isinstance(k, Column) else F.lit(k)))


def mul_components(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def div_components(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def cross(a: Column, b: Column) -> Column:
    """Of two vectors of three components."""
    t = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(t(1, 2), t(2, 0), t(0, 1))


def angle(a: Column, b: Column) -> Column:
    """In radians, accurate for small angles: atan2(|a x b|, a . b) by norms of the difference and sum of unit vectors."""
    u, v = normalize(a), normalize(b)
    return 2 * F.atan2(norm(subtract(u, v)), norm(add(u, v)))


def largest_abs_component(a: Column) -> Column:
    """Index from 0; the first of equals."""
    m = F.transform(a, F.abs)
    return (F.array_position(m, F.array_max(m)) - 1).cast("int")


def component_order(a: Column) -> Column:
    """Indices from 0 of the components by absolute value, smallest first; equal ones by index."""
    pairs = F.transform(a, lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("at")))
    return F.transform(F.array_sort(pairs), lambda p: p["at"])


def unit_orthogonal(a: Column) -> Column:
    """A unit vector at a right angle to one of two components (turned by 90 degrees) or of three (crossed with the axis that comes before its largest component)."""
    k = largest_abs_component(a)
    axis = F.array(*((F.when(F.pmod(k + 2, F.lit(3)) == i, 1.0).otherwise(0.0)) for i in range(3)))
    return normalize(F.when(F.size(a) == 2, F.array(-F.get(a, F.lit(1)), F.get(a, F.lit(0)))).otherwise(cross(a, axis)))


def each(a: Column, name: str) -> Column:
    """floor, ceil, sqrt, abs, rint (half to even) or iround (half away from zero) of every component."""
    fs = {"floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "abs": F.abs, "rint": F.rint, "iround": lambda x: F.round(x).cast("bigint")}
    return F.transform(a, lambda x: fs[name](x))


def any_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def vectors_almost_equal(a: Column, b: Column, margin: float) -> Column:
    """Whether every two components differ by less than the margin."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < margin), lambda x: x)


def vector_less(a: Column, b: Column) -> Column:
    """Lexicographic order of the components."""
    return a < b


def det3(m: Column) -> Column:
    """Determinant of a 3 x 3 matrix: an array of three rows."""
    return dot(m[0], cross(m[1], m[2]))


def trace3(m: Column) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


def transpose3(m: Column) -> Column:
    return F.array(*(F.array(*(m[j][i] for j in range(3))) for i in range(3)))


def mat_vec3(m: Column, v: Column) -> Column:
    return F.array(*(dot(m[i], v) for i in range(3)))


def mat_mul3(a: Column, b: Column) -> Column:
    return F.array(*(F.array(*(a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3))) for i in range(3)))


def inverse3(m: Column) -> Column:
    """The inverse by cofactors; null for a singular matrix."""
    d = det3(m)
    cols = F.array(cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1]))
    return F.when(d != 0, F.transform(transpose3(cols), lambda r: F.transform(r, lambda x: x / d)))


def frobenius3(m: Column) -> Column:
    return F.sqrt(norm2(F.flatten(m)))


def mat_add3(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, add)


def mat_sub3(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, subtract)


def mat_scale3(m: Column, k) -> Column:
    return F.transform(m, lambda r: scale(r, k))


def adjugate3(m: Column) -> Column:
    """The transposed matrix of cofactors: the inverse times the determinant."""
    return transpose3(F.array(cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])))


def row3(m: Column, i: int) -> Column:
    return m[i]


def col3(m: Column, i: int) -> Column:
    return F.array(*(m[j][i] for j in range(3)))


def from_cols3(a: Column, b: Column, c: Column) -> Column:
    return transpose3(F.array(a, b, c))


def diagonal3(v: Column) -> Column:
    return F.array(*(F.array(*(v[i] if i == j else F.lit(0.0) for j in range(3))) for i in range(3)))


def outer3(v: Column) -> Column:
    """The symmetric matrix of a vector's products with itself."""
    return F.array(*(F.array(*(v[i] * v[j] for j in range(3))) for i in range(3)))


def cross_matrix3(v: Column) -> Column:
    """The matrix that crosses v with the vector it is applied to."""
    zero = F.lit(0.0)
    return F.array(F.array(zero, -v[2], v[1]), F.array(v[2], zero, -v[0]), F.array(-v[1], v[0], zero))


def rotation3(v: Column) -> Column:
    """The rotation about v by |v| radians."""
    t, w = norm(v), normalize(v)
    one = F.array(*(F.lit(1.0) for _ in range(3)))
    return mat_add3(mat_add3(mat_scale3(outer3(w), 1 - F.cos(t)), mat_scale3(cross_matrix3(w), F.sin(t))), mat_scale3(diagonal3(one), F.cos(t)))


def between3(v: Column, m: Column, u: Column) -> Column:
    """v transposed times m times u."""
    return dot(mat_vec3(m, u), v)


def project2(m: Column, v: Column) -> Column:
    """m as a projective map of a point of two components."""
    t = mat_vec3(m, F.array(v[0], v[1], F.lit(1.0)))
    return F.array(t[0] / t[2], t[1] / t[2])


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6372797.560856) -> Column:
    """Distance in metres of two points in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) * 0.5), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2.0 * F.lit(radius) * F.asin(F.sqrt(h))


def gaps(values: Column) -> Column:
    """Successive differences of an array, the first value kept."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


#: Codes that may be folded.
SMALL = 5


def delta16(values: list[int]) -> list[int]:
    """Code of an ascending list of distinct 16-bit numbers: the first value, then gaps less one; runs of equal codes are folded.

    After a code below SMALL the next number is doubled, or it is odd and tells how often that code comes again, less one.
    """
    from itertools import groupby

    codes = [v - (values[i - 1] + 1 if i else 0) for i, v in enumerate(values)]
    runs = [(k, len(list(g))) for k, g in groupby(codes)] if codes else []
    out, doubled = [], False
    for code, n in runs:
        small = code < SMALL
        for _ in range(1 if small else n):
            out.append(code << doubled & 0xFFFF)
            doubled = small
        if small and n == 2:
            out.append(code << 1)
        elif small and n > 2:
            out.append((n - 2) << 1 | 1)
            doubled = False
    return out


def undelta16(codes: list[int]) -> list[int]:
    """The inverse of delta16()."""
    out: list[int] = []
    prev, doubled = None, False
    for c in codes:
        if doubled and c & 1:
            steps, doubled = [prev] * ((c >> 1) + 1), False
        else:
            prev = c >> 1 if doubled else c
            steps, doubled = [prev], prev < SMALL
        for s in steps:
            out.append(s if not out else out[-1] + s + 1)
    return out


def delta_encode(values: Column) -> Column:
    """delta16() of an array column, by Arrow batches."""
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else delta16([int(x) for x in v]))

    return run(values)


def delta_decode(codes: Column) -> Column:
    """undelta16() of an array column, by Arrow batches."""
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else undelta16([int(x) for x in v]))

    return run(codes)


def zigzag(n: Column) -> Column:
    """Signed 64-bit numbers as such ones that small absolute values stay small: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("bigint")))


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits; negative ones count as large."""
    return F.when(n < 0, 10).when(n == 0, 1).otherwise(F.ceil((log2_floor(n) + 1) / 7)).cast("int")


def varint(n: Column) -> Column:
    """The number in groups of seven bits, lowest first, each but the last with its upper bit set, as binary."""
    size = varint_size(n)
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.call_function("shiftrightunsigned", n, (i * 7)).bitwiseAND(F.lit(127).cast("bigint")) + F.when(i < size - 1, 128).otherwise(0))
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def fixed64(n: Column) -> Column:
    """Eight bytes, lowest first, as binary."""
    h = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))
