"""The language model against word-by-word sums, exact counts and held-out documents."""

import collections
import math
import re

import numpy as np
import pytest

from shardwright.llm import lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, h string")


def test_hashes_are_functions_of_the_word():
    texts = ["The cat\tthe\n\nCAT é".encode(), b"", b" \n", b"cat", b"a\0", b"a"]
    h, size, per = lm_score.word_hashes(texts)
    assert per.tolist() == [5, 0, 0, 1, 1, 1] and size.tolist() == [3, 3, 3, 3, 2, 3, 2, 1]
    assert h[0] == h[2] and h[1] == h[3] == h[5] and h[6] != h[7]
    many = [f"word{k}".encode() for k in range(200_000)]
    got = lm_score.word_hashes([b" ".join(many)])[0]
    assert got[:50].tolist() == [lm_score.word_hashes([m])[0][0] for m in many[:50]]
    assert len(set(got.tolist())) == 200_000


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_word_is_a_target_once_wherever_its_text_lies(rounds):
    for per in ([10], [1, 0, 2, 7], [0, 0], [5, 5, 5]):
        got = [lm_score.targets(np.array(per), rounds, r).tolist() for r in range(rounds)]
        assert sorted(sum(got, [])) == list(range(sum(per)))
        for r in range(rounds):
            own = [x + b for n, b in zip(per, np.cumsum([0, *per]).tolist(), strict=False) for x in range(n) if x % rounds == r for _ in (0,)]
            assert got[r] == own


def test_counts_are_exact(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = collections.Counter(w for r in d.collect() for w in words(r.text))
    hashed = dict(zip(lm_score.word_hashes([b" ".join(want)])[0].tolist(), want.values(), strict=True))
    for at_once in (1 << 20, 64):
        assert {r.h: r.c for r in lm_score.word_counts(d, at_once=at_once).collect()} == hashed


#: So few known words that all kinds occur: told apart by the network, of a middle group, rare.
SMALL = lm_score.Layout(known=60, least=3, groups=4, in_group=8, middle=3)


def brute(texts, fitted, model, own):
    """Log-likelihood and unseen words of each text, word by word."""
    vocab, total = model["vocab"], collections.Counter(w for t in fitted for w in words(t))
    e, scale, b, wo, bo, wi, bi = (x.astype(float) for x in lm_score.unpack(model["flat"], SMALL))
    of = {h: k for k, h in enumerate(vocab["h"].tolist())}
    soft = lambda z: z - np.logaddexp.reduce(z)
    key = lambda w: of.get(int(lm_score.word_hashes([w])[0][0]))
    rare = {w for w in total if key(w) is None}
    n, t = sum(total[w] for w in rare), max(len(rare), 1)
    out = []
    for text in texts:
        ws, here, ll, unseen = words(text), collections.Counter(words(text)), 0.0, 0
        ks = [key(w) for w in ws]
        ctx = [SMALL.own + SMALL.middle if k is None else int(vocab["context"][k]) for k in ks]
        n_rare = sum(k is None for k in ks)
        for p, w in enumerate(ws):
            h = np.tanh(b + sum(e[ctx[p + o] if 0 <= p + o < len(ws) else SMALL.edge] * scale[k] for k, o in enumerate((-2, -1, 1, 2))))
            k = ks[p]
            g = SMALL.rare if k is None else int(vocab["group"][k])
            ll += soft(h @ wo + bo)[g]
            if k is None:
                c = total[w] - own * here[w]
                unseen += c <= 0
                ll += math.log((max(c, 0) + t * 64.0 ** -(len(w) + 1)) / (n + t - own * n_rare))
            elif vocab["place"][k] >= 0:
                ll += soft(h @ wi[g] + bi[g])[vocab["place"][k]]
            else:
                ll += float(vocab["share"][k])
        out.append((len(ws), ll, unseen))
    return out


@pytest.mark.parametrize("own", [True, False])
def test_scores_equal_word_by_word_sums(spark, own):
    rng = np.random.default_rng(1)
    weights = 1 / np.arange(1, 301)
    texts = [" ".join(f"w{k}" for k in rng.choice(300, rng.integers(1, 90), p=weights / weights.sum())) for _ in range(40)] + [None, "", "Once\tonly", "x" * 120]
    d = table(spark, list(enumerate(texts)) + [(None, texts[0])])
    model = lm_score.fit_lm(d, batch=64, layout=SMALL)
    assert {0, 7} < set(model["vocab"]["group"].tolist()) | {7} and (model["vocab"]["place"] < 0).any()
    more = texts if own else ["w1 w2 new1 w299", *texts[:3]]
    got = lm_score.score_lm(table(spark, list(enumerate(more))), model, own=own).collect()
    assert len(got) == len(more)
    for r in got:
        n, ll, unseen = brute([more[r.doc_id]], [*texts, texts[0]], model, own)[0]
        assert (r.n_words, r.n_unseen) == (n, unseen) and r.log_likelihood == pytest.approx(ll, rel=1e-4, abs=1e-4)
        assert (r.mean_log_likelihood is None) == (not n)


def test_gradient():
    rng = np.random.default_rng(2)
    params = [rng.normal(0, 0.3, s) for s in SMALL.shapes()]
    ctx, group = rng.integers(0, SMALL.edge + 1, (50, 4)), rng.integers(0, SMALL.rare + 1, 50)
    place = np.where(group < SMALL.groups, rng.integers(0, SMALL.in_group, 50), -1)
    loss = lambda: -lm_score.log_probs(params, ctx, group, place).mean()
    before = [x.copy() for x in params]
    sums = [np.zeros_like(x) + 1e-300 for x in params]
    lm_score.train_step(params, sums, ctx, group, place, 0.0)
    for x, x0, s in zip(params, before, sums, strict=True):
        x[:] = x0
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(12)]:
            old = x[at]
            x[at] = old + 1e-5
            up = loss()
            x[at] = old - 1e-5
            down = loss()
            x[at] = old
            assert ((up - down) / 2e-5) ** 2 == pytest.approx(s[at], rel=1e-3, abs=1e-9)


def test_beats_the_unigram_on_held_out_documents(spark):
    """Default settings; the unigram model has the same counts and no windows. Documents that occur twice stand out."""
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5))
    model = lm_score.fit_lm(d.where(part > 0))
    flat = np.zeros_like(model["flat"])
    p = lm_score.unpack(flat, lm_score.Layout())
    p[4][:], p[6][:] = model["vocab"]["outer"], model["vocab"]["inside"]
    mean = lambda m: (lambda r: r[0] / r[1])(lm_score.score_lm(d.where(part == 0), m, own=False).agg({"log_likelihood": "sum", "n_words": "sum"}).select("sum(log_likelihood)", "sum(n_words)").first())
    assert mean(model) > mean({**model, "flat": flat}) + 0.1
    assert lm_score.score_lm(d.limit(0), model).collect() == []
    assert lm_score.fit_lm(d.limit(0))["flat"].shape == model["flat"].shape


def test_documents_that_occur_twice_stand_out(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    common = [word() for _ in range(50)]
    texts = [" ".join(word() if rng.random() < 0.2 else common[rng.integers(0, 50)] for _ in range(60)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(10)]
    d = table(spark, rows)
    got = {r.doc_id: r.mean_log_likelihood for r in lm_score.score_lm(d, lm_score.fit_lm(d)).collect()}
    twice = [got[k] for k in got if k >= 1000 or k < 10]
    once = [got[k] for k in got if 10 <= k < 1000]
    assert min(twice) > max(once)


def test_the_model_is_one_whatever_the_batches(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    a = lm_score.fit_lm(d, batch=256)["flat"]
    try:
        spark.conf.set(key, "7")
        b = lm_score.fit_lm(d, batch=256)["flat"]
    finally:
        spark.conf.unset(key)
    assert np.array_equal(a, b)
