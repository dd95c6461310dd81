"""String, number and URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_base(c: Column, base: int) -> Column:
    """An unsigned 64-bit number (given signed or not negative) in a base from 2 to 36, upper case."""
    return F.conv(c.cast("string"), 10, base)


def hex64(c: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def human_bytes(c: Column) -> Column:
    """1024-based sizes: 12B, 1.5K (one decimal), 2.25M and above (two); whole divisions between units as integers."""
    n = F.abs(c.cast("bigint"))
    sign = F.when(c < 0, "-").otherwise("")
    out, unit = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))), n
    for k, name in enumerate("KMGTPE"):
        places = 1 if name == "K" else 2
        text = F.format_string(f"%.{places}f", F.bround(unit / F.lit(1024.0), places))  # sizes in 1024ths are exact; halves go to even
        last = name == "E"
        reach = F.lit(True) if last else n < F.lit(1 << (10 * (k + 2)))
        out = out.when(reach, F.concat(text, F.lit(name)))
        unit = F.floor(unit / 1024)
    return F.concat(sign, out)


def human_bytes_exact(c: Column) -> Column:
    """The largest unit that divides the size without rest."""
    n = F.abs(c.cast("bigint"))
    out = None
    for k in range(6, 0, -1):
        fits = (n >= F.lit(1 << 10 * k)) & (n % F.lit(1 << 10 * k) == 0)
        text = F.concat(F.floor(n / F.lit(1 << 10 * k)).cast("string"), F.lit("BKMGTPE"[k]))
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.concat(F.when(c < 0, "-").otherwise(""), out.otherwise(F.concat(n.cast("string"), F.lit("B"))))


def parse_human_bytes(c: Column) -> Column:
    """The number of bytes of 12, 12B, 1.5K ... as double; null if malformed."""
    number = F.regexp_extract(c, r"^\s*(-?\d*\.?\d+)([BKMGTPEbkmgtpe]?)B?$", 1)
    unit = F.upper(F.regexp_extract(c, r"^\s*(-?\d*\.?\d+)([BKMGTPEbkmgtpe]?)B?$", 2))
    power = F.when(unit.isin("", "B"), 0)
    for k, name in enumerate("KMGTPE", 1):
        power = power.when(unit == name, k)
    return F.when(number != "", number.try_cast("double") * F.pow(F.lit(1024.0), power))


def _thousandths(n: Column) -> Column:
    """n / 1000 with two decimals, rounded as the double nearest to it is: its 52 binary places are compared exactly."""
    whole = F.floor(n / 10)
    m = (n / F.lit(1000.0) * F.lit(2.0**52)).cast("bigint").cast("decimal(20,0)") * 1000
    exact = n.cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(17,0)")
    up = (n % 10 > 5) | ((n % 10 == 5) & ((m > exact) | ((m == exact) & (whole % 2 == 1))))
    h = whole + up.cast("bigint")
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def human_int(c: Column) -> Column:
    """1000-based counts: 999, 1.50k, 2.00M, 3.00B, 4.00T; powers of ten beyond."""
    n = F.abs(c.cast("bigint"))
    out, unit = F.when(n < 1000, n.cast("string")), n
    for k, name in enumerate("kMBT"):
        out = out.when(n < F.lit(1000 ** (k + 2)), F.concat(_thousandths(unit), F.lit(name)))
        unit = F.floor(unit / 1000)
    return F.concat(F.when(c < 0, "-").otherwise(""), out.otherwise(F.format_string("%.2E", n.cast("double"))))


def parse_human_int(c: Column) -> Column:
    """The inverse: 1.5k to 1500, rounded half away from zero; null if malformed."""
    m = r"^\s*(-?\d*\.?\d+)([kMBT]?)$"
    unit, by = F.regexp_extract(c, m, 2), F.lit(1.0)
    for name, f in (("k", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        by = F.when(unit == name, f).otherwise(by)
    return F.round(F.regexp_extract(c, m, 1).try_cast("double") * by).cast("bigint")


def elapsed(seconds: Column) -> Column:
    """A duration in its natural unit, three significant digits at most: us, ms, s, min, h, days, months, years."""
    s = F.abs(seconds.cast("double"))

    def digits(x):
        places = F.when(x >= 100, 0).when(x >= 10, 1).otherwise(2)
        text = F.when(places == 0, F.format_string("%.0f", x)).when(places == 1, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    steps = ((0.001, 1e-6, "us"), (1.0, 1e-3, "ms"), (60.0, 1.0, "s"), (3600.0, 60.0, "min"), (86400.0, 3600.0, "h"), (30 * 86400.0, 86400.0, "days"), (365.2425 * 86400, 30.436875 * 86400, "months"))
    out = None
    for below, unit, name in steps:
        text = F.concat(digits(s / F.lit(unit)), F.lit(f" {name}"))
        out = F.when(s < below, text) if out is None else out.when(s < below, text)
    return F.concat(F.when(seconds < 0, "-").otherwise(""), out.otherwise(F.concat(digits(s / F.lit(365.2425 * 86400)), F.lit(" years"))))


def url_encode(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and - _ . ! ~ * ' ( ); a space is %20."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def parse_int(c: Column, kind: str = "bigint") -> Column:
    """Strict base 10; null on failure or overflow."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast(kind))


def parse_double(c: Column) -> Column:
    """A floating number with optional white space around; null on failure."""
    return F.when(~c.rlike(r"[dDfF]\s*$"), F.trim(c).try_cast("double"))


def parse_int_base(c: Column, base: int) -> Column:
    """Digits of a base from 2 to 36, with a sign; null on other characters or beyond 64 bits."""
    digits, most = _DIGITS[:base], 1
    while base**most < 1 << 63:
        most += 1
    sign_and = F.upper(F.trim(c))
    plain = F.regexp_replace(F.regexp_replace(sign_and, "^-", ""), "^0+(?=.)", "")
    number = F.aggregate(F.filter(F.split(plain, ""), lambda x: x != ""), F.lit(0).cast("decimal(38,0)"), lambda n, d: (n * base + F.instr(F.lit(digits), d) - 1).cast("decimal(38,0)"))
    good = sign_and.rlike(f"^-?[{digits}]+$") & (F.length(plain) <= most)
    return F.when(good, F.when(sign_and.startswith("-"), -number).otherwise(number)).try_cast("bigint")


def leading_int(c: Column, default: int) -> Column:
    """The decimal number at the start of a string, else the default."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(default))


def parse_uint(c: Column, bits: int = 32) -> Column:
    """Strict base 10 without a minus; null on failure or beyond `bits` (32: bigint, 64: decimal(20,0))."""
    n = F.when(c.rlike(r"^\s*\+?\d+\s*$"), F.trim(c).try_cast("decimal(38,0)"))
    return F.when(n < F.lit(str(1 << bits)).cast("decimal(38,0)"), n).cast("bigint" if bits == 32 else "decimal(20,0)")


def leading_number(c: Column, default: int, bits: int = 64, signed: bool = True, octal: bool = False) -> Column:
    """The whole number at the start of a string, else the default; also the default where it does not fit.

    octal: a leading 0 means base 8 and 0x base 16, as in C; otherwise zeros mean nothing.
    """
    lo, hi = (-(1 << bits - 1), 1 << bits - 1) if signed else (0, 1 << bits)
    sign = F.when(F.regexp_extract(c, r"^\s*([+-]?)", 1) == "-", -1).otherwise(1)
    big = lambda digits, base: F.aggregate(F.split(F.upper(digits), ""), F.lit(0).cast("decimal(38,0)"), lambda n, d: (n * base + F.instr(F.lit(_DIGITS[:base]), d) - 1).cast("decimal(38,0)"))
    dec = F.regexp_extract(c, r"^\s*[+-]?(\d+)", 1)
    n = F.when((dec != "") & (F.length(F.ltrim(F.lit("0"), dec)) <= 20), dec.try_cast("decimal(38,0)"))
    if octal:
        hexa, eight = F.regexp_extract(c, r"^\s*[+-]?0[xX]0*([0-9A-Fa-f]{1,16})", 1), F.regexp_extract(c, r"^\s*[+-]?0+([0-7]{1,22})", 1)
        n = F.when(c.rlike(r"^\s*[+-]?0[xX][0-9A-Fa-f]"), F.when(hexa != "", big(hexa, 16))).when(eight != "", big(eight, 8)).when(c.rlike(r"^\s*[+-]?0"), F.lit(0).cast("decimal(38,0)")).otherwise(n)
    n = n * sign
    good = (n >= F.lit(str(lo)).cast("decimal(38,0)")) & (n < F.lit(str(hi)).cast("decimal(38,0)"))
    kind = "bigint" if signed or bits < 64 else "decimal(20,0)"
    return F.coalesce(F.when(good, n).cast(kind), F.lit(str(default)).cast(kind))


def char_class(chars: str) -> str:
    """A set of characters as a class of a regular expression."""
    return "[" + "".join("\\" + x if not x.isalnum() else x for x in dict.fromkeys(chars)) + "]"


def span(c: Column, chars: str) -> Column:
    """How many characters at the start are of the set."""
    return F.length(F.regexp_extract(c, f"^{char_class(chars)}*", 0))


def span_not(c: Column, chars: str) -> Column:
    """How many characters at the start are not of the set."""
    return F.length(F.regexp_extract(c, f"^[^{char_class(chars)[1:-1]}]*", 0))


def keep_chars(c: Column, chars: str) -> Column:
    """The characters of the set, in order."""
    return F.regexp_replace(c, f"[^{char_class(chars)[1:-1]}]", "")


def find(c: Column, what: str) -> Column:
    """Place from 0 of the first occurrence, -1 for none."""
    return F.instr(c, F.lit(what)) - 1


def find_last(c: Column, what: str) -> Column:
    """Place from 0 of the last occurrence, -1 for none."""
    at = F.instr(F.reverse(c), F.lit(what[::-1]))
    return F.when(at == 0, -1).otherwise(F.length(c) - at + 1 - len(what))


def split_step(c: Column, delimiter: str) -> Column:
    """(head, rest): what stands before the first delimiter, and what after it; without one all is head and nothing rest."""
    at = F.instr(c, F.lit(delimiter))
    rest = F.substring(c, at + len(delimiter), F.length(c))
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("head"), F.when(at > 0, rest).otherwise("").alias("rest"))


def leading_double(c: Column, default: float) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(default))


def leading_hex(c: Column, default: int) -> Column:
    digits = F.regexp_extract(c, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,16})", 1)
    return F.when(digits == "", F.lit(default)).otherwise(F.conv(digits, 16, -10).cast("bigint"))


def parse_bool(c: Column, default: bool) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "y", "t"), True).when(v.isin("0", "false", "no", "n", "f"), False).otherwise(F.lit(default))


def file_extension(c: Column) -> Column:
    """What follows the last dot of the last path component, else an empty string."""
    return F.regexp_extract(c, r"\.([^./]*)$", 1)


def dir_name(c: Column) -> Column:
    return F.when(c.contains("/"), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def join_path(a: Column, b: Column) -> Column:
    """One slash between two parts; an absolute second part is taken as relative."""
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def count_byte(c: Column, char: str) -> Column:
    """How often one ASCII character occurs."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))


def lines(c: Column) -> Column:
    """The lines of a text: split at line feeds, one carriage return before each stripped; no line after a final line feed."""
    whole = F.split(c, "\n")
    whole = F.when(F.element_at(whole, -1) == "", F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def csv_fields(c: Column, delimiter: str = ",") -> Column:
    """The fields of one CSV line: quotes only with a comma, "" inside quotes is a quote, text after a closing quote is
    ignored, unquoted fields are trimmed, a trailing delimiter makes an empty field, an empty line has none."""
    import re

    d = re.escape(delimiter)
    if delimiter != ",":
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, d), F.trim))
    field = rf'\s*"((?:[^"]|"")*)"[^{d}]*|([^{d}]*)'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), c), F.lit(rf"{d}({field})"), 1)
    clean = F.transform(found, lambda x: F.when(x.rlike(r'^\s*"'), F.replace(F.regexp_extract(x, r'^\s*"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(clean)


def words(c: Column) -> Column:
    """The maximal runs of letters."""
    return F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1)


def python_json(c: Column) -> Column:
    """JSON out of a printed Python literal: escapes of bytes become spaces, None, True and False their JSON names, and
    single quotes that open or close a string double ones (apostrophes inside words stay)."""
    out = F.regexp_replace(c, r"\\x[0-9a-fA-F]{2}", " ")
    out = F.regexp_replace(out, r"(?<=[:\[,{]\s?)'|'(?=\s?[:\],}])", '"')
    for name, to in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"(?<=[:\[,]\s?){name}(?=\s?[,\]}}])", to)
    return out


def html_table(df, most_rows: int = 1000) -> str:
    """A sortable HTML table of at most `most_rows` rows, for a report page."""
    import html

    rows = df.limit(most_rows).collect()
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f'<table class="sortable"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'
