"""Masked pseudo-likelihood: a window network predicts every word from both sides, exact corpus counts tell rare words apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_pieces

#: Bytes of text whose words are hashed at once (a longer text is taken whole); the arrays for that take some fifty times as much.
PIECE = 500_000
#: Tasks whose networks are added up at once.
FAN_IN = 128
#: Characters that the spelling of an unseen word is drawn from.
LETTERS = 64

_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list = []


@dataclass(frozen=True)
class Layout:
    """What the network holds, whatever the size of the corpus.

    known: the most frequent words, which go to all tasks (all other words live in a table that grows with the corpus);
    least: how often a known word occurs at least; groups, in_group: the network itself tells groups * in_group words
    apart, the first of them in the first group and so on; middle: groups of equal mass of the other known words, after
    which comes one group of all rare words; side: words of the window on each side; width: of the hidden layer.
    """

    known: int = 1 << 16
    least: int = 32
    groups: int = 16
    in_group: int = 128
    middle: int = 31
    side: int = 2
    width: int = 16

    @property
    def own(self) -> int:
        return self.groups * self.in_group

    @property
    def rare(self) -> int:
        return self.groups + self.middle

    @property
    def edge(self) -> int:
        """The context number beyond a text's ends; before it come those of the words told apart, the middle groups and all rare words."""
        return self.own + self.middle + 1

    def shapes(self) -> list[tuple[int, ...]]:
        outer = self.rare + 1
        return [(self.edge + 1, self.width), (2 * self.side, self.width), (self.width,), (self.width, outer), (outer,), (self.groups, self.width, self.in_group), (self.groups, self.in_group)]


def _powers(n: int):
    """Powers of an odd number and of its inverse modulo 2**64, for hashing all words of a chunk at once."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS


def word_hashes(texts: list[bytes]):
    """(64-bit hash and bytes of every word, number of words of each text): words are lower-cased (A-Z) runs without ASCII white space."""
    import numpy as np

    joined = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = (x[: len(joined) + 1] for x in _powers(len(joined) + 1))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)])])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h.view(np.int64), ends - starts, np.diff(np.searchsorted(starts, limits))


def word_counts(docs: DataFrame, text_col: str = "text", at_once: int = 1 << 20) -> DataFrame:
    """(h, c): how often each word of the corpus occurs, over all documents, by its 64-bit hash; a table that grows with the corpus.

    A task adds up the words that it has read and sends them on whenever it holds `at_once` different ones.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def merged():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(c, first)

        for b in batches:
            for _, texts in in_pieces(b, "t", PIECE):
                h, c = np.unique(word_hashes(texts)[0], return_counts=True)
                if not len(h):
                    continue
                held.append((h, c.astype(np.int64)))
                size += len(h)
                if size >= at_once:
                    held = [merged()]
                    size = len(held[0][0])
                    if size >= at_once // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["h", "c"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["h", "c"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def unpack(flat, at: Layout):
    """The network's arrays: context vectors, a scale for each place of the window, bias; group weights and bias; weights and bias inside each group."""
    import numpy as np

    out, begin = [], 0
    for s in at.shapes():
        n = int(np.prod(s))
        out.append(flat[begin : begin + n].reshape(s))
        begin += n
    return out


def vocabulary(known: list[tuple[int, int]], tokens: int, at: Layout) -> dict:
    """From the known words (hash, count), most frequent first, and the number of all words: sorted hashes, and of each word its group, its
    place in the group or -1, its context number and the logarithm of its share of the group (0 where the network tells words apart)."""
    import numpy as np

    n = len(known)
    h, c = np.array([x[0] for x in known], np.int64), np.array([x[1] for x in known], np.float64)
    rank = np.arange(n)
    rest = c[at.own:]
    middle = np.minimum((np.cumsum(rest) - rest / 2) / max(rest.sum(), 1) * at.middle, at.middle - 1).astype(np.int64)
    group = np.concatenate([rank[:at.own] // at.in_group, at.groups + middle])
    place = np.where(rank < at.own, rank % at.in_group, -1)
    mass = np.bincount(group, c, at.rare + 1)
    mass[at.rare] = max(tokens - c.sum(), 0)
    share = np.where(rank < at.own, 0, np.log(c / np.maximum(mass[group], 1)))
    inside = np.full((at.groups, at.in_group), 1e-9)
    inside[group[:at.own], place[:at.own]] = c[:at.own]
    order = np.argsort(h)
    take = lambda x, kind: x[order].astype(kind)
    return {
        "at": at, "h": h[order], "group": take(group, np.int16), "place": take(place, np.int16), "context": take(np.where(rank < at.own, rank, at.own + group - at.groups), np.int16), "share": take(share, np.float32),
        "outer": np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32), "inside": np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def look_up(vocab: dict, h):
    """Of words by hash: group, place (-1: not told apart by the network), context number, log share of the group; unknown words are rare ones."""
    import numpy as np

    lay = vocab["at"]
    other = (lay.rare, -1, lay.own + lay.middle, 0)
    if not len(vocab["h"]):
        return tuple(np.full(len(h), x, t) for x, t in zip(other, (np.int16, np.int16, np.int16, np.float32), strict=True))
    at = np.minimum(np.searchsorted(vocab["h"], h), len(vocab["h"]) - 1)
    hit = vocab["h"][at] == h
    return tuple(np.where(hit, vocab[k][at], vocab[k].dtype.type(x)) for k, x in zip(("group", "place", "context", "share"), other, strict=True))


def windows(context, per_text, at: Layout):
    """The context numbers around each word, at.side before and after it, at.edge beyond the text's ends."""
    import numpy as np

    n = len(context)
    owner = np.repeat(np.arange(len(per_text), dtype=np.int32), per_text)
    out = np.full((n, 2 * at.side), at.edge, np.int16)
    for k in range(1, at.side + 1):
        if n > k:
            same = owner[k:] == owner[:-k]
            out[k:, at.side - k] = np.where(same, context[:-k], at.edge)
            out[:-k, at.side + k - 1] = np.where(same, context[k:], at.edge)
    return out


def _hidden(params, ctx):
    import numpy as np

    e, place, b = params[:3]
    h = np.take(e * place[0] + b, ctx[:, 0], axis=0)
    for k in range(1, len(place)):
        h += np.take(e * place[k], ctx[:, k], axis=0)
    return np.tanh(h, out=h)


def _exp(z):
    """exp(z) in place, up to a factor for each row, the sums of its rows, and the logarithm of the factor.

    Scores are small as a rule; where they are not, each row's largest is taken off first.
    """
    import numpy as np

    if z.size and (z.max() > 60 or z.max(axis=1).min() < -60):
        top = z.max(axis=1)
        z -= top[:, None]
    else:
        top = 0
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype), top


def _by_group(group, place, groups: int):
    """(group, rows) of the words that the network tells apart."""
    import numpy as np

    rows = np.flatnonzero(place >= 0)
    rows = rows[np.argsort(group[rows], kind="stable")]
    cuts = np.searchsorted(group[rows], np.arange(groups + 1))
    return [(g, rows[cuts[g] : cuts[g + 1]]) for g in range(groups) if cuts[g + 1] > cuts[g]]


def log_probs(params, ctx, group, place, at_once: int = 4096):
    """log P(group | window) of each word, plus log P(word | group, window) where the network tells words apart."""
    import numpy as np

    _, _, _, wo, bo, wi, bi = params
    h = _hidden(params, ctx)
    out = np.empty(len(h), h.dtype)

    def add(rows, own, w, b, which, set_):
        for k in range(0, len(own), at_once):
            part = slice(k, k + at_once)
            z = own[part] @ w + b
            hit = z[np.arange(len(z)), which[part]]
            _, total, top = _exp(z)
            out[rows[part]] = hit - np.log(total) - top + (0 if set_ else out[rows[part]])

    add(np.arange(len(h)), h, wo, bo, group, True)
    for g, rows in _by_group(group, place, len(wi)):
        add(rows, h[rows], wi[g], bi[g], place[rows], False)
    return out


def train_step(params, sums, ctx, group, place, rate):
    """One Adagrad step on a batch, in place."""
    import numpy as np

    e, scale, b, wo, bo, wi, bi = params
    n = len(group)
    h = _hidden(params, ctx)

    def errors(own, w, bias, which):
        """The gradient of the loss in the scores."""
        p, total, _ = _exp(own @ w + bias)
        p *= (1 / (total * n))[:, None]
        p[np.arange(len(p)), which] -= 1 / n
        return p

    p = errors(h, wo, bo, group)
    dh = p @ wo.T
    gwi, gbi = np.zeros_like(wi), np.zeros_like(bi)
    for g, rows in _by_group(group, place, len(wi)):
        own = h[rows]
        q = errors(own, wi[g], bi[g], place[rows])
        gwi[g], gbi[g] = own.T @ q, q.sum(0)
        dh[rows] += q @ wi[g].T
    dh *= 1 - h * h
    # All places of the window share the context vectors: rows of one number are added up after a sort.
    ge, gs = np.zeros_like(e), np.empty_like(scale)
    for k in range(len(scale)):
        order = np.argsort(ctx[:, k], kind="stable")
        ids = ctx[order, k]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        own, part = ids[first], np.add.reduceat(np.take(dh, order, axis=0), first, axis=0)
        gs[k] = (part * e[own]).sum(0)
        ge[own] += part * scale[k]
    for x, s, g in zip(params, sums, (ge, gs, dh.sum(0), h.T @ p, p.sum(0), gwi, gbi), strict=True):
        s += g * g
        x -= rate * g / np.sqrt(s)


def targets(per_text, rounds: int, r: int):
    """The words masked in round r: each `rounds`-th of each text, from the r-th on. A word's round depends on its place in its text alone; over all rounds each word is masked once."""
    import numpy as np

    begins = np.repeat(np.cumsum(per_text) - per_text, per_text)
    return np.flatnonzero((np.arange(len(begins)) - begins) % rounds == r)


def fit_lm(docs: DataFrame, rounds: int = 2, rate: float = 0.1, batch: int = 4096, seed: int = 0, text_col: str = "text", layout: Layout = Layout()) -> dict:  # noqa: B008
    """The language model of a corpus, from all its words.

    First all words are counted (word_counts).  The known words of the layout go to the
    tasks; the counts of all words stay a table.  The network predicts a word's group, and for the most
    frequent words which word of the group it is, from the words on both sides.  In each of `rounds` rounds every task
    masks each `rounds`-th word of all its texts, so that every word of the corpus is a target once, and takes Adagrad
    steps of `batch` words from the common start, which don't depend on how rows arrive in batches.  The tasks'
    networks are averaged by the number of words they saw: slices of them travel as rows and are added up by a tree of
    which no node has more than FAN_IN children (up to FAN_IN**3 tasks), and one network of a fixed size reaches the driver.
    """
    import numpy as np

    counts = cut(word_counts(docs, text_col))
    known = counts.where(F.col("c") >= layout.least).orderBy(F.desc("c"), "h").limit(layout.known).collect()
    types, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    vocab = vocabulary([(r.h, r.c) for r in known], int(tokens), layout)
    rng = np.random.default_rng(seed)
    start = [rng.normal(0, 0.1, s).astype(np.float32) for s in layout.shapes()]
    start[1][:], start[2][:], start[4][:], start[6][:] = 1, 0, vocab["outer"], vocab["inside"]
    flat, parts = np.concatenate([x.ravel() for x in start]), 8

    for r in range(rounds):
        begin = flat.copy()

        def run(batches, begin=begin, r=r):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            flat, seen, held, size = begin.copy(), 0, [], 0
            params = unpack(flat, layout)
            sums = [np.full_like(x, 1e-4) for x in params]

            def learn(least):
                nonlocal held, size
                if size < least:
                    return
                ctx, g, p = (np.concatenate(x) for x in zip(*held, strict=True))
                done = 0
                while size - done >= least:
                    train_step(params, sums, ctx[done : done + batch], g[done : done + batch], p[done : done + batch], rate)
                    done = min(size, done + batch)
                held, size = [(ctx[done:], g[done:], p[done:])], size - done

            for b in batches:
                for _, texts in in_pieces(b, "t", PIECE):
                    h, _, per = word_hashes(texts)
                    group, place, context, _ = look_up(vocab, h)
                    picks = targets(per, rounds, r)
                    held.append((windows(context, per, layout)[picks], group[picks], place[picks]))
                    size += len(picks)
                    seen += len(picks)
                    learn(batch)
            learn(1)
            if seen:
                task = TaskContext.get().partitionId()
                out = np.array_split(flat.astype(np.float64) * seen, parts)
                ints = lambda v, kind=pa.int32(): pa.array(v, kind)
                yield pa.RecordBatch.from_arrays([ints(range(parts)), ints([task] * parts), ints([seen] * parts, pa.int64()), pa.array([v.tobytes() for v in out])], ["part", "grp", "seen", "x"])

        def add(pdf):
            import numpy as np
            import pandas as pd

            x = sum((np.frombuffer(v, np.float64) for v in pdf.x), np.zeros(1))
            return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "grp": [int(pdf.grp.iloc[0])], "seen": [int(pdf.seen.sum())], "x": [x.tobytes()]})

        kind = "part int, grp int, seen bigint, x binary"
        nets = docs.select(F.col(text_col).alias("t")).mapInArrow(run, kind)
        for _ in range(3):
            nets = nets.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int")).groupBy("part", "grp").applyInPandas(add, kind)
        got = nets.collect()
        if got:
            flat = np.concatenate([np.frombuffer(x.x, np.float64) / x.seen for x in sorted(got, key=lambda x: x.part)]).astype(np.float32)
    rare = int(tokens) - sum(x.c for x in known)
    return {"vocab": vocab, "flat": flat, "counts": counts, "rare_tokens": rare, "rare_types": int(types) - len(known)}


def score_lm(docs: DataFrame, model: dict, own: bool = True, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 1 << 17) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words of log P(word | both sides)), mean_log_likelihood, n_unseen.

    Each word's own place is masked, the words around it are seen.  P(word | ...) is the network's for the most frequent
    words; for other known words it is P(group | ...) times the word's share of the group; for all rare words it is
    P(rare | ...) times (c + t * s) / (n + t), where c counts the word and n all rare words in the rest of the corpus, t is the
    number of different rare words and s the chance of spelling the word from LETTERS characters.  The rest of the corpus is
    all but the document itself where docs are rows of it (own=True), so that a document doesn't vouch for its own words;
    for other documents it is the corpus.  n_unseen counts the words that the rest of the corpus doesn't hold.

    The network scores texts in one pass; only rare words are shuffled, each once for a document, to meet the table of counts,
    and their sums come back to the document by the place of its row in the checkpointed table.  Null or empty text: no words,
    sum 0, mean null.  Ids may be null or repeated, every row is scored alone; an empty table gives no rows; other columns are not read.
    """
    vocab, flat, lay = model["vocab"], model["flat"], model["vocab"]["at"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        params = unpack(flat, lay)
        for b in batches:
            for first, texts in in_pieces(b, "t", PIECE):
                h, size, per = word_hashes(texts)
                group, place, context, lp = look_up(vocab, h)
                ctx, lp = windows(context, per, lay), lp.astype(np.float64)
                for k in range(0, len(h), rows_at_once):
                    part = slice(k, k + rows_at_once)
                    lp[part] += log_probs(params, ctx[part], group[part], place[part])
                owner = np.repeat(np.arange(len(per)), per)
                total = np.bincount(owner, lp, len(per))
                # The rare words of each text, each once.
                at = np.flatnonzero(group == lay.rare)
                at = at[np.lexsort((h[at], owner[at]))]
                new = np.ones(len(at), bool)
                new[1:] = (h[at[1:]] != h[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(at))).astype(np.int32)
                one = at[begin]
                offsets = pa.array(np.searchsorted(owner[one], np.arange(len(per) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[one], n, size[one].astype(np.int32))]
                rare = np.bincount(owner[at], minlength=len(per)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.slice(first, len(texts)).column(0), pa.array(per.astype(np.int64)), pa.array(total), pa.array(rare), *lists], ["id", "n_words", "known", "n_rare", "h", "n", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = cut(docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words bigint, known double, n_rare bigint, h array<bigint>, n array<int>, size array<int>"))
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    words = scored.select("row", "n_rare", F.explode(F.arrays_zip("h", "n", "size")).alias("x")).select("row", "n_rare", F.col("x.h").alias("h"), F.col("x.n").alias("n"), F.col("x.size").alias("size"))
    met = words.join(model["counts"], "h", "left")
    out_of = F.col("n") if own else F.lit(0)
    c = F.coalesce("c", F.lit(0)) - out_of
    types = float(max(model["rare_types"], 1))
    rest = F.lit(float(model["rare_tokens"]) + types) - (F.col("n_rare") if own else F.lit(0))
    log_p = F.log((F.greatest(c, F.lit(0)) + F.lit(types) * F.pow(F.lit(float(LETTERS)), -F.least(F.col("size") + 1, F.lit(150)))) / rest)
    sums = met.select("row", (log_p * F.col("n")).alias("l"), F.when(c > 0, 0).otherwise(F.col("n")).alias("u")).groupBy("row").agg(F.sum("l").alias("rare"), F.sum("u").alias("n_unseen"))
    out = scored.select("row", "id", "n_words", "known").join(sums, "row", "left")
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"), F.coalesce("n_unseen", F.lit(0)).cast("long").alias("n_unseen"))
