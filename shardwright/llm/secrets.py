"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import trees

#: Words that name a secret, as part of an identifier.
NAMED = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|auth|bearer|credential)"
_ID = "[A-Za-z0-9_.-]"
#: What stands before an assigned value: an identifier with a word that names a secret, and =, :, := or =>.
#: The look ahead passes over most words at once.
ASSIGNED = rf"(?<!{_ID})(?={_ID}*+[\"']?[ \t]{{0,4}}[=:]){_ID}*?(?i:{NAMED}){_ID}{{0,40}}+[\"']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}[\"']?"
#: What stands before a password in a URL.
USERINFO = r"://[^\s/@:\"']{0,200}:"
#: A candidate: an assigned value of any length and characters but blanks and quotes; a password in a URL; any other maximal run of 16
#: or more characters that keys, hashes and paths consist of.  What stands before the value is part of the match.
CANDIDATE = rf"{ASSIGNED}[^\s\"']*[^\s\"',;)]|{USERINFO}[^\s/@]+(?=@)|(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{16,}}+={{0,2}}"
#: Common pieces of identifiers and prose; what they cover of a candidate speaks against a secret.
DICTIONARY = (
    "example", "sample", "test", "user", "name", "file", "path", "index", "main", "http", "https", "www", "com", "org", "net", "html", "php", "json", "mail", "data", "image", "config", "public", "static", "assets", "version", "release", "build",
    "the", "and", "that", "with", "from", "this", "have", "which", "their", "about", "tion", "ment", "able", "ing", "ness", "ight", "ough", "ence", "ance", "ther", "ation", "ent", "ion", "per", "con", "ver", "pro", "est", "ist", "ity", "placeholder", "changeme", "lorem", "ipsum", "your", "here", "eaux", "elle", "ción", "cion", "keit", "lich", "ung", "sch",
)
FEATURES = ("length", "transitions", "classes", "digit_ratio", "upper_ratio", "symbol_ratio", "hex", "entropy_like", "dictionary", "path", "named", "assigned", "userinfo", "reference", "prefix", "repeated")


def _lead(match):
    """What stands before the value in a match of CANDIDATE."""
    return F.regexp_extract(match, f"^(?:{ASSIGNED}|{USERINFO})", 0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, row, n, gap, secret, before, after): every candidate of every whole text, n from 0; row numbers the texts,
    gap is the number of code points since the candidate before.

    The text is split at the candidates, so neighbours come from the pieces around them; a text without a candidate,
    as most are, is only searched once.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.regexp_extract_all(text_col, F.lit(f"({CANDIDATE})"), 1).alias("m")).where(F.size("m") > 0)
    parts = found.select("doc_id", F.xxhash64("t").alias("text_hash"), "m", F.split("t", CANDIDATE, -1).alias("p"), F.monotonically_increasing_id().alias("row"))
    sizes = F.zip_with("m", F.slice("p", 1, F.size("m")), lambda m, p: F.struct(m.alias("m"), F.char_length(p).alias("gap"), F.right(p, F.lit(48)).alias("before")))
    parts = parts.select("doc_id", "text_hash", "row", F.posexplode(F.zip_with(sizes, F.slice("p", 2, F.size("m")), lambda x, p: F.struct(x.m.alias("m"), x.gap.alias("gap"), x.before.alias("before"), F.left(p, F.lit(16)).alias("after")))).alias("n", "x"))
    parts = parts.withColumn("lead", _lead(F.col("x.m")))
    lead = F.char_length("lead")
    return parts.select("doc_id", "text_hash", "row", "n", (F.col("x.gap") + lead).alias("gap"), F.expr("substring(x.m, char_length(lead) + 1)").alias("secret"), F.right(F.concat("x.before", "lead"), F.lit(48)).alias("before"), "x.after")


def with_starts(found: DataFrame) -> DataFrame:
    """candidates() with start, the place in the text in code points: a running sum over the candidates of each text."""
    so_far = Window.partitionBy("row").orderBy("n")
    return found.withColumn("start", (F.sum(F.col("gap") + F.char_length("secret")).over(so_far) - F.char_length("secret")).cast("long"))


def with_features(found: DataFrame) -> DataFrame:
    """found (secret, before, after) with the forest's features."""
    s, n = F.col("secret"), F.greatest(F.char_length("secret"), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(s, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "-")
    runs = F.regexp_count(kinds, F.lit("a+|B+|1+|-+")).cast("double")
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return (
        found.withColumn("length", F.least(n, F.lit(200.0)))
        .withColumn("transitions", (runs - 1) / n)
        .withColumn("classes", sum((count(p) > 0).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))
        .withColumn("digit_ratio", count("[0-9]") / n)
        .withColumn("upper_ratio", count("[A-Z]") / n)
        .withColumn("symbol_ratio", count("[^A-Za-z0-9]") / n)
        .withColumn("hex", flag(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$")))
        .withColumn("entropy_like", F.size(F.array_distinct(F.split(s, ""))) / F.least(n, F.lit(40.0)))
        .withColumn("dictionary", 1 - F.char_length(F.regexp_replace(s, words, "")) / n)
        .withColumn("path", F.regexp_count(s, F.lit(r"[/.]")) + F.when(F.col("before").rlike(r"(://|[/\\@.])$"), 2.0).otherwise(0.0))
        .withColumn("named", flag(F.col("before").rlike(f"(?i){NAMED}")))
        .withColumn("assigned", flag(F.col("before").rlike(r"""[=:>]\s*["']?$""")))
        .withColumn("userinfo", flag(F.col("before").rlike(r"://[^/\s]*:$")))
        .withColumn("reference", flag(s.rlike(r"^[$<{%\[]|[({]|\*{3}|^[A-Z_]+$")))
        .withColumn("prefix", flag(s.rlike("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk[-_]|pk_|AIza|eyJ)")))
        .withColumn("repeated", F.regexp_count(s, F.lit(r"(.)\1")) / n)
    )


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    """(secret, before, after, label): n labelled findings, the same at every call.

    Half are secrets: keys and tokens in hex, base64 or mixed letters, named or bare with a vendor's prefix, short passwords that
    are named and assigned or stand in a URL.  Half are what pattern scans report by mistake: long words in any case, names in
    camel case, hosts, file paths, card and order numbers, UUIDs, checksums of files and packages, placeholders, and what follows a
    secret's name without being one: words, references to variables, calls, settings, ports.
    """
    import random
    import string

    r = random.Random(seed)
    syll = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "ver", "tion", "ment", "lich", "eau", "cion"]
    open_syll = [c + v for c in ("b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "br", "gr", "pl", "st", "sh") for v in ("a", "e", "i", "o", "u", "ar", "el", "in", "ou", "ill")]
    word = lambda a=2, b=4: "".join(r.choice(s) for s in [r.choice((syll, open_syll))] for _ in range(r.randint(a, b)))
    rand = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    hexa, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    names = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "passwd", "API_KEY", "pwd", "db_password", "Authorization"]

    def named():
        return r.choice(names) + r.choice([' = "', "=", ": ", "='", " = ", ': "', '": "', " => '", ":"])

    def password():
        """Short and chosen by a person or a generator: letters of both kinds, digits and often a symbol."""
        kind = r.random()
        if kind < 0.1:
            return word(2, 3).capitalize() + r.choice("!@#$%&*?") + word(1, 3)
        if kind < 0.5:
            return word(1, 3).capitalize() + r.choice(["", r.choice("!@#$%&*?-_")]) + rand(string.digits, 1, 4) + r.choice(["", r.choice("!@#$%&*?")])
        if kind < 0.6:
            return "".join(r.choice([c, c, {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c)]) for c in word(3, 4)) + rand(string.digits, 1, 3)
        s = rand(alnum + "!@#$%&*?^~+", 7, 15)
        return s if any(c.isdigit() for c in s) else s + rand(string.digits, 1, 2)

    rows = []
    for k in range(n):
        lead, tail = f"{word()} {word()} ", f" {word()} {word()}"
        before, after = lead, tail
        kind = r.random()
        if k % 2 and kind < 0.15:
            s = r.choice(["AKIA", "ASIA"]) + rand(string.ascii_uppercase + string.digits, 16, 16)
        elif k % 2 and kind < 0.3:
            s = r.choice(["ghp_", "sk-", "xoxb-", "AIza", "gho_"]) + rand(alnum, 24, 40)
        elif k % 2 and kind < 0.4:
            s, before, after = password(), f"{lead}{r.choice(['postgres', 'https', 'ftp', 'redis'])}://{word(1, 2)}:", f"@{word(1, 2)}.example"
        elif k % 2:
            before = lead + named()
            s = r.choice([lambda: rand(hexa, 16, 64), lambda: rand(b64, 20, 64), lambda: rand(alnum, 16, 40), password, password])()
        elif kind < 0.45:
            before = lead + named()
            s = r.choice(
                [
                    lambda: r.choice([str.lower, str.capitalize, str.upper])(word(1, 4)),
                    lambda: r.choice([str.lower, str.capitalize])(word(1, 4)) + r.choice(["", "", ".", "!", "?"]),
                    lambda: r.choice(["True", "False", "None", "Null", "Yes", "No", "Required", "See", "Basic", "Token", "Digest", "not", "none", "set", "see", "in", "on", "off"]),
                    lambda: word(1, 2) + r.choice(["", "-", "_", "."]) + r.choice(["1", "2", "3", "64", "256", "v2", "2024"]),
                    lambda: r.choice(["true", "false", "null", "None", "required", "optional", "string", "yes", "no", "basic", "Bearer", "bearer", "the", "a", "is", "undefined", "empty", "***", "****", "xxxx", "...", "-", "changeme", "example", "your"]),
                    lambda: r.choice(["$", "${", "{{", "<", "%", "[", "@"]) + r.choice([str.upper, str.lower])(word(1, 3) + "_" + word(1, 2)) + r.choice(["", "}", ">", "%", "}}", "]"]),
                    lambda: r.choice(["get_", "os.", "self.", "config.", "env.", "request.", ""]) + word(1, 3) + r.choice(["()", "(", ".get(", "[0]", "_" + word(1, 2), "." + word(1, 2)]),
                    lambda: "*" * r.randint(3, 12),
                    lambda: "/".join(["", *(word(1, 2) for _ in range(r.randint(1, 4)))]),
                    lambda: rand(string.digits, 1, 5),
                    lambda: r.choice(["https://", "http://"]) + word() + ".example.com/" + word(),
                    lambda: word(1, 2) + "-" + word(1, 2) + r.choice(["", ".", "-" + word(1, 2)]),
                ]
            )()
        else:
            s = r.choice(
                [
                    lambda: r.choice([str.lower, str.upper, str.capitalize, str.title])(word(6, 10)) + r.choice(["", ".", "..."]),
                    lambda: "".join(word(2, 3).capitalize() for _ in range(r.randint(3, 5))),
                    lambda: r.choice(["mail", "www.", "img", "cdn"]) + str(r.randint(0, 9)) + "." + word(1, 3) + r.choice([".example.com", ".example.org", ".com"]),
                    lambda: "/".join(word(1, 2) for _ in range(r.randint(3, 6))) + r.choice([".html", ".py", ".jpg", "/"]),
                    lambda: rand(string.digits, 16, 22),
                    lambda: "-".join(rand(hexa, a, a) for a in (8, 4, 4, 4, 12)),
                    lambda: r.choice(["your", "xxxx", "changeme", "placeholder", "example", "0000"]) * r.randint(3, 6),
                    lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 99)}-{word()}",
                    lambda: rand(hexa, 32, 64),
                ]
            )()
            if len(s) < 16:
                s += word(6, 8)
            if set(s) <= set(hexa) and len(s) >= 32 and not s.isdigit():
                before = lead + r.choice(["sha256:", "md5 ", "commit ", "checksum: ", "integrity=", "etag "])
            elif r.random() < 0.15:
                before = lead + r.choice(["token ", "password ", 'href="', "src=", "id=", "file: "])
        after = ('"' if before.endswith('"') else "'" if before.endswith("'") else "") + after
        rows.append((s, before[-48:], after[:16], k % 2))
    return spark.createDataFrame(rows, "secret string, before string, after string, label int")


def fit_findings(labelled: DataFrame, most_rows: int = 20_000) -> dict:
    """A forest from labelled findings, of which at most `most_rows` (first by a hash) are read."""
    rows = labelled.orderBy(F.xxhash64("secret", "before"), "secret", "before", "after", "label").limit(most_rows)
    data = sorted(tuple(r) for r in with_features(rows).select(*FEATURES, "label").collect())
    return trees.forest([r[:-1] for r in data], [r[-1] for r in data], trees=20, depth=5)  # code generation has a limit on the size of one method


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n, start, length, secret, score, is_secret: every candidate of every whole text with the forest's verdict.

    start and length are code points; n numbers the candidates of a text.  The forest is fitted on labelled findings (secret, before,
    after, label; labelled_findings() where none are given) and applied as an expression; texts are scanned where they lie and
    only candidates are shuffled, to number their places.  Null and empty texts have no candidates.  Rows repeating an id are
    scanned each; a null id is kept.  Other columns are not read; an empty table gives no rows.
    """
    model = fit_findings(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = with_features(candidates(docs, id_col, text_col))
    # Scored before the shuffle that numbers the places: neighbours stay behind, and no later filter repeats the trees.
    found = found.select("doc_id", "text_hash", "row", "n", "gap", "secret", F.round(trees.score(model, [F.col(c) for c in FEATURES]), 9).alias("score"))
    return with_starts(found).select(F.col("doc_id").alias(id_col), "text_hash", "n", "start", F.char_length("secret").cast("long").alias("length"), "secret", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "<SECRET>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `mark` in place of each secret, where it was found and nowhere else.

    findings is the whole result of scan_secrets(docs): a text is split at its candidates again, and each meets its own
    verdict by number, so secrets that are part of others or of longer words do no harm and the work grows with the text.
    Rows without findings, null ids and null texts stay as they are; rows repeating an id meet the findings of their own text.
    """
    own = findings.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h")).agg(F.sort_array(F.collect_set(F.struct("n", "is_secret"))).alias("__v"))
    out = docs.join(own, (docs[id_col] == own["__id"]) & (F.xxhash64(docs[text_col]) == own["__h"]), "left")
    out = out.withColumn("__m", F.regexp_extract_all(text_col, F.lit(f"({CANDIDATE})"), 1)).withColumn("__p", F.split(text_col, CANDIDATE, -1))
    marked = F.zip_with("__m", "__v", lambda m, v: F.when(v.is_secret, F.concat(_lead(m), F.lit(mark))).otherwise(m))
    whole = F.concat(F.get("__p", F.lit(0)), F.array_join(F.zip_with(marked, F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), lambda m, p: F.concat(m, p)), ""))
    return out.select(*(F.when(F.col("__v").isNotNull(), whole).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
