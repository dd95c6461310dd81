"""Quality rules: counting rules, then a linear-chain CRF that labels lines as content or boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces

#: The line features, in the order of a model's emission weights.
FEATURES = ("bias", "log_chars", "word_chars", "upper", "digits", "symbols", "bangs", "punctuated", "repeated", "few_words")
#: Weights that hold where no labelled rows of both classes are at hand: marks of boilerplate are symbols, shouting, repeats and digits.
#: trans[a][b] is the score of a line labelled b after one labelled a (0: boilerplate, 1: content).
PRIOR = {"emit": [1.5, 0.1, 0.0, -4.0, -3.0, -4.0, -4.0, 0.6, -1.5, -0.3], "trans": [[1.0, 0.0], [0.0, 1.0]]}

_UPPER, _DIGIT, _SYMBOL, _BANG, _SPACE, _INNER, _MARK = 1, 2, 4, 8, 16, 32, 64


def _classes():
    import numpy as np

    c = np.zeros(256, np.uint8)
    for k, chars in ((_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_SYMBOL, b"#*$%&|<>"), (_BANG, b"!"), (_SPACE, b" \t\n\x0b\x0c\r"), (_MARK, b".,;:?")):
        c[list(chars)] |= k
    c[0x80:0xC0] |= _INNER  # bytes inside a code point
    return c


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text; words: text.split()."""
    import numpy as np

    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    cls = _classes_once()[np.frombuffer(text, np.uint8)]
    chars = int(np.count_nonzero((cls & (_SPACE | _INNER)) == 0))
    symbols = int(np.count_nonzero(cls & _SYMBOL))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if n >= 4:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:-1] >> np.uint64(29))) ^ (h[2:] * np.uint64(0x165667B19E3779F9) + (h[2:] >> np.uint64(31)))
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


_ONCE: list = []


def _classes_once():
    if not _ONCE:
        _ONCE.append(_classes())
    return _ONCE[0]


def line_features(texts: list[bytes]):
    """Of all lines with a word: (features, words, text number), lines in order. One pass of array operations for all texts."""
    import numpy as np

    lines, owner, seen_before = [], [], []
    for i, t in enumerate(texts):
        seen: set[bytes] = set()
        for x in t.split(b"\n"):
            if x and not x.isspace():
                lines.append(x)
                owner.append(i)
                seen_before.append(x in seen)
                seen.add(x)
    if not lines:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    cls = _classes_once()[joined]
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    space = (cls & _SPACE) != 0
    word_start = ~space
    word_start[1:] &= space[:-1]
    per = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    words = per(word_start)
    chars = np.maximum(per((cls & (_SPACE | _INNER)) == 0), 1)
    marked = (cls & _MARK) != 0
    marked[:-1] &= space[1:]  # a mark that ends a word
    marks = per(marked)
    share = lambda k: per((cls & k) != 0) / chars
    f = np.stack(
        [np.ones(len(lines)), np.log1p(np.minimum(chars, 200)) / 5, np.minimum(chars / words, 30) / 10, share(_UPPER), share(_DIGIT), np.minimum(per((cls & _SYMBOL) != 0) / words, 1), np.minimum(per((cls & _BANG) != 0) / words, 1), (marks > 0).astype(float), np.array(seen_before, float), (words < 5).astype(float)],
        axis=1,
    )
    return f, words, np.array(owner)


def viterbi(scores, trans) -> list[int]:
    """The best labels (1: content) of one text's lines; scores: emission score of content over boilerplate for each line; trans: as in a model."""
    (t00, t01), (t10, t11) = trans
    a = b = 0.0  # best path that ends as boilerplate, as content
    back = []
    for k, s in enumerate(scores):
        if k:
            fa, fb = b + t10 > a + t00, b + t11 >= a + t01
            back.append((fa, fb))
            a, b = (b + t10 if fa else a + t00), (b + t11 if fb else a + t01)
        b += s
    y = int(b >= a)
    out = [y]
    for fa, fb in reversed(back):
        y = int(fb if y else fa)
        out.append(y)
    return out[::-1]


def spliced(good: list[bytes], bad: list[bytes], seed: int = 0) -> tuple[list[bytes], list[list[int]]]:
    """Training texts with labelled lines (of lines that have a word): passages of bad texts set into good ones at known places.

    Every good text comes whole, and once more with a passage of a bad text before, inside or after it; every bad text
    comes whole, and once more as a passage cut at random beside lines of a good text.  Lines of good texts are content,
    lines of bad ones boilerplate, so most texts change label within.
    """
    import random

    r = random.Random(seed)
    has_word = lambda x: bool(x) and not x.isspace()
    lines = [[[x for x in t.split(b"\n") if has_word(x)] for t in part] for part in (bad, good)]
    lines = [[x for x in part if x] for part in lines]
    out = [([y] * len(x), x) for y, part in enumerate(lines) for x in part]
    if lines[0] and lines[1]:
        for y, part in enumerate(lines):
            for x in part:
                other = r.choice(lines[1 - y])
                i = r.randrange(len(other))
                piece = other[i : i + r.choice([1, 1, 2, 3, 5, 8, len(other)])]
                at = r.choice([0, len(x), r.randint(0, len(x))])
                out.append(([y] * at + [1 - y] * len(piece) + [y] * (len(x) - at), x[:at] + piece + x[at:]))
    return [b"\n".join(x) for _, x in out], [y for y, _ in out]


def train_crf(texts: list[bytes], labels: list[list[int]], rounds: int = 200, rate: float = 0.3, l2: float = 1e-3, piece: int = 48) -> dict:
    """A CRF by maximum likelihood from texts and the labels (1: content) of their lines that have a word.

    Forward and backward sums over pieces of `piece` lines; lines of both labels weigh the same in all.  The four
    transition weights are free.  With lines of one label only: PRIOR.
    """
    import numpy as np

    y = np.array([v for x in labels for v in x], np.int64)
    if len(set(y.tolist())) < 2:
        return PRIOR
    f, _, owner = line_features(texts)
    first = np.searchsorted(owner, owner)
    pos = (np.arange(len(owner)) - first) % piece
    seq = np.cumsum(pos == 0) - 1
    n, t = seq[-1] + 1, pos.max() + 1
    mask, gold = np.zeros((n, t), bool), np.zeros((n, t), np.int64)
    mask[seq, pos], gold[seq, pos] = True, y
    pair = mask[:, 1:] & mask[:, :-1]
    ones = np.maximum((gold * mask).sum(axis=1), 0) / mask.sum(axis=1)
    share = y.mean()
    weight = (ones / share + (1 - ones) / (1 - share)) / 2
    seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).T @ weight for b in (0, 1)] for a in (0, 1)]).sum(axis=-1)
    w, trans = np.array(PRIOR["emit"], float), np.array(PRIOR["trans"], float)
    mw, vw = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    scale = (mask * weight[:, None]).sum()
    for k in range(1, rounds + 1):
        s = np.zeros((n, t))
        s[seq, pos] = f @ w
        (t00, t01), (t10, t11) = trans
        # Log sums over all labellings up to and from each line, one array for each label (0 boilerplate, 1 content).
        f0, f1, b0, b1 = np.zeros((n, t)), s.copy(), np.zeros((n, t)), np.zeros((n, t))
        for i in range(1, t):
            here = mask[:, i]
            f0[:, i] = np.where(here, np.logaddexp(f0[:, i - 1] + t00, f1[:, i - 1] + t10), f0[:, i - 1])
            f1[:, i] = np.where(here, np.logaddexp(f0[:, i - 1] + t01, f1[:, i - 1] + t11) + s[:, i], f1[:, i - 1])
        for i in range(t - 2, -1, -1):
            here, after = mask[:, i + 1], b1[:, i + 1] + s[:, i + 1]
            b0[:, i] = np.where(here, np.logaddexp(b0[:, i + 1] + t00, after + t01), 0)
            b1[:, i] = np.where(here, np.logaddexp(b0[:, i + 1] + t10, after + t11), 0)
        z = np.logaddexp(f0[:, -1], f1[:, -1])[:, None]
        p = np.exp(np.minimum(f1 + b1 - z, 0)) * mask
        before, later = (f0[:, :-1], f1[:, :-1]), (b0[:, 1:], b1[:, 1:] + s[:, 1:])
        expected = np.array([[((np.exp(np.minimum(before[a] + trans[a, b] + later[b] - z, 0)) * pair).T @ weight).sum() for b in (0, 1)] for a in (0, 1)])
        g = np.append((((gold - p) * mask * weight[:, None])[seq, pos]) @ f, (seen - expected).ravel()) / scale
        g -= l2 * np.append(w, trans.ravel())
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        step = rate * (1 - k / (rounds + 1)) * (mw / (1 - 0.9**k)) / (np.sqrt(vw / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return {"emit": [float(x) for x in w], "trans": trans.tolist()}


def fit_on_labels(docs: DataFrame, labels: DataFrame, most_rows: int = 1500, most_chars: int = 20_000) -> dict:
    """A CRF from a bounded sample of labelled documents, whose lines are labelled by spliced().

    At most `most_rows` labels, first by a hash of doc_id and spread over both classes alike, and of their documents
    those of `most_chars` characters or less go to the driver; nothing else of the corpus does.  Null labels are skipped,
    of rows repeating an id one counts; without documents of both labels the prior holds.
    """
    some = None
    for q in (0, 1):
        part = labels.where(F.col("quality") == q).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2)
        some = part if some is None else some.unionByName(part)
    some = some.select(F.col("doc_id").alias("__id"), "quality").dropDuplicates(["__id"])
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).where(F.char_length("text").between(1, most_chars)).select("doc_id", "text", "quality")
    rows = sorted(found.limit(2 * most_rows).collect(), key=lambda r: (r.doc_id, r.text))
    return train_crf(*spliced([r.text.encode() for r in rows if r.quality == 1], [r.text.encode() for r in rows if r.quality == 0]))


def judge_quality(docs: DataFrame, model: dict, keep_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, n_content_lines, kept (and the columns in carry).

    base_failed: fewer than 50 words, or more than half of the words inside 3-word windows found twice or more.  Then
    the CRF labels the lines that have a word; content_share is the share of the words on content lines, and a text
    stays with `keep_share` or more.  Whole texts, no shuffle; memory follows the longest text.  Null or
    empty text: no words, base_failed.  An id may be null or repeated; every row is judged alone.
    """
    carry = carry or []
    emit, trans = list(model["emit"]), [list(map(float, x)) for x in model["trans"]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = np.array(emit)
        for b in batches:
            for first, texts in in_pieces(b, "__text"):
                rows = [base_counts(t, t.split()) for t in texts]
                f, words, owner = line_features(texts)
                score = f @ w
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                share, content = [], []
                for i in range(len(texts)):
                    lo, hi = ends[i], ends[i + 1]
                    y = np.array(viterbi(score[lo:hi].tolist(), trans), bool) if hi > lo else np.zeros(0, bool)
                    total = int(words[lo:hi].sum())
                    share.append(float(words[lo:hi][y].sum() / total) if total else 0.0)
                    content.append(int(y.sum()))
                counts = np.array(rows, np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                share = np.array(share)
                new = [pa.array(counts[:, k]) for k in range(5)] + [pa.array(failed), pa.array(share), pa.array(np.array(content, np.int64)), pa.array(~failed & (share >= keep_share))]
                own = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(k) for k in range(1 + len(carry))] + new, names)

    names = [id_col, *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "n_content_lines", "kept"]
    kinds = [docs.schema[c].dataType.simpleString() for c in [id_col, *carry]] + ["bigint"] * 5 + ["boolean", "double", "bigint", "boolean"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select(id_col, *carry, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, model: dict, keep_share: float = 0.5) -> DataFrame:
    """docs without the rejected rows, with the same columns.  The verdict travels with the row, so nothing is shuffled.

    Null and empty texts are rejected (no words); a row repeating an id is judged by its own text; null ids are rows like
    others; an empty table gives no rows; columns of any name stay as they are.
    """
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("__row"), F.col("text"))
    judged = judge_quality(inner, model, keep_share, "__row", "text")
    return judged.where("kept").select("__row.*")
