"""The pipeline's near-duplicates against brute force over whole shingle sets."""

import random

import numpy as np

import corpus_pipeline
from shardwright.llm import near_copies, simhash

from test_text_operators import WORD, brute_groups, docs, odd_rows


def brute_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def edited(r, n, changes):
    """A text of n words and one of it with some words replaced."""
    w = [f"w{r.randint(0, 5000)}" for _ in range(n)]
    v = list(w)
    for k in r.sample(range(n), changes):
        v[k] = f"new{k}"
    return " ".join(w), " ".join(v)


def test_groups_are_those_of_brute_force(spark):
    r = random.Random(11)
    rows = odd_rows()
    for k in range(40):
        a, b = edited(r, r.randint(80, 300), r.randint(1, 4))
        rows += [(1000 + 2 * k, a), (1001 + 2 * k, b)]
    sets = [brute_set(t) for _, t in rows]
    want = brute_groups([i for i, _ in rows], lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    df = docs(spark, rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "component_id")
    got = near_copies.near_copies(df).collect()
    assert sorted(map(str, zip([i for i, _ in rows], want, strict=True))) == sorted(str((g.doc_id, g.component_id)) for g in got)
    assert near_copies.near_copies(df.limit(0)).collect() == []
    assert {x.doc_id for x in simhash.drop_near_duplicates(df).collect()} - {None} == set(want) - {None}


def test_stage_drops_an_edited_copy_and_keeps_a_looser_one(spark):
    r = random.Random(12)
    near, loose = edited(r, 200, 2), edited(r, 200, 20)
    left = corpus_pipeline.near_duplicates(spark, docs(spark, enumerate([*near, *loose])), "").collect()
    assert sorted(x.doc_id for x in left) == [0, 2, 3]


def test_no_link_of_a_group_is_lost(spark, monkeypatch):
    """Groups of texts that are mostly not similar enough: every pair that shares a band is compared or in one component already."""
    r = random.Random(13)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):  # one family: all share a long passage, some are near copies of each other
        tail = [f"t{k // 2}_{j}" for j in range(25)]
        tail[k % 2] = f"own{k}"
        rows.append((k, " ".join(base + tail)))
    r.shuffle(rows)
    sets = [brute_set(t) for _, t in rows]
    want = brute_groups([i for i, _ in rows], lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    assert len(set(want)) == 30
    got = {g.doc_id: g.component_id for g in near_copies.near_copies(docs(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want


def test_large_groups_make_no_pairs_by_the_square(spark, monkeypatch):
    """Large groups of mostly unlike texts: rows of pairs follow the members; links are those of brute force, also over many blocks."""
    r = random.Random(14)
    rows, base = [], [f"w{k}" for k in range(60)]
    for k in range(240):
        tail = [f"t{k // 2}_{j}" for j in range(25)]
        tail[k % 2] = f"own{k}"
        rows.append((k, " ".join(base + tail)))
    rows += [(1000 + k, " ".join(base + [f"c{k}"])) for k in range(40)]  # near copies of each other
    r.shuffle(rows)
    sets = [brute_set(t) for _, t in rows]
    want = brute_groups([i for i, _ in rows], lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    members, made, hashed, to_verify, in_blocks = [], [], [], near_copies._to_verify, near_copies._in_blocks

    def counted(rest, *a):
        out = to_verify(rest, *a).cache()
        members.append(rest.count())
        made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "_to_verify", counted)
    monkeypatch.setattr(near_copies, "_in_blocks", lambda rest, *a: hashed.append(rest.count()) or in_blocks(rest, *a))
    for shingles_of_block in (1 << 18, 1000):
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles_of_block)
        members.clear(), made.clear(), hashed.clear()
        got = {g.doc_id: g.component_id for g in near_copies.near_copies(docs(spark, rows)).collect()}
        assert [got[i] for i, _ in rows] == want
        assert hashed and hashed[0] > 16 and sum(made) <= 5 * members[0]


def test_shared_counts_are_exact():
    r = random.Random(15)
    a, b = ([np.array(sorted(r.sample(range(60), r.randint(1, 30))), np.uint64) for _ in range(n)] for n in (7, 5))
    for most in (1, 40, 1 << 20):
        assert near_copies._shared(a, b, most).tolist() == [[len({*x.tolist()} & {*y.tolist()}) for y in b] for x in a]


def test_ball_pairs_link_equal_and_close_fingerprints(spark):
    texts = ["a b c d e f g h"] + [f"w{k} " * 3 + "x y z" for k in range(5)] + ["A B c d e f g h"]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    got = {(p.a, p.b) for p in simhash.ball_pairs(rows, 5, 2).collect()}
    want = brute_groups(range(len(texts)), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    assert brute_groups(range(len(texts)), lambda i, j: (max(i, j), min(i, j)) in got) == want and (6, 0) in got
