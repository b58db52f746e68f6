import random
import re
from collections import Counter

import numpy as np
import pytest

from litsieve.llm import jaccard
from litsieve.storage import materialize

from .corpus import LONG, ODD, documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    own = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in own if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(own):
        for b, t in own[:k]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in own)


def edited(rng, words, n):
    own = list(words)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return own


def corpus(seed):
    rng = random.Random(seed)
    rows, at = list(ODD), 1000
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 8, 11, 13, 20, 60, 150, 400]))]
        chain = base
        for _ in range(rng.randrange(12)):
            kind = rng.randrange(4)
            if kind == 0:
                text = base
            elif kind == 1:
                text = edited(rng, base, rng.randrange(1, 3 + len(base) // 50))
            elif kind == 2:  # a chain of small steps
                chain = text = edited(rng, chain, max(1, len(base) // 80))
            else:
                text = base + [f"tail{rng.randrange(99)}" for _ in range(rng.randrange(1 + len(base) // 9))]
            at += 1
            rows.append((at, " ".join(text).upper() if rng.random() < 0.2 else "  ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = Counter(tuple(r) for r in jaccard.join(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_one_large_near_group_with_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(4)))) for k in range(150)]
    assert Counter(tuple(r) for r in jaccard.join(documents(spark, rows)).collect()) == brute(rows)


def test_linked_sets_share_a_signature():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randrange(1, 400)
        s = [rng.getrandbits(64) for _ in range(n)]
        t = s[: n - rng.randrange(n // 10 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(n // 15 + 1))]
        a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (s, t))
        if len(a) and len(b) and jaccard.linked(a, b) and jaccard.node_of(a) != jaccard.node_of(b):
            assert set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())


def test_tree_loses_no_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(7919)) for _ in range(200)]
    sets += [s[: len(s) - len(s) // 20] for s in sets]
    tree = jaccard.CountTree(np.array([jaccard.count_vector(s) for s in sets]), np.array([len(s) for s in sets]))
    for s in sets[::7]:
        got = set(tree.candidates(jaccard.count_vector(s), len(s)).tolist())
        assert {k for k, t in enumerate(sets) if jaccard.linked(s, t)} <= got


def test_hashes_follow_words():
    assert len(set(jaccard.word_hashes(b"a b a  c\n\x0bb").tolist())) == 3
    some = ["a b c d", "", "A B  C d ", "x", "é é"]
    for t, u in zip(some, jaccard.shingle_sets(some), strict=True):
        assert u.tolist() == jaccard.shingle_set(t).tolist() and len(u) == len(shingles(t))


def test_nothing_and_one_of_each(spark):
    assert jaccard.join(empty(spark)).count() == 0
    rows = [*ODD, (77, LONG), (78, "a b c"), (79, "a b c"), (79, "other text here now")]
    kept = jaccard.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 8 not in ids and 77 not in ids and ids[5] == 1 and ids[78] == 1 and ids[None] == 1


def test_sets_of_one_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 8, 80), (4, 8, 80), (5, None, None)], "doc_id long, node long, chk long")
    clash = jaccard.clashes(rows)
    got = {r.doc_id: r.node for r in jaccard.told_apart(rows, clash).collect()}
    assert got[1] != got[2] and got[3] == got[4] == 8 and got[5] is None
    assert jaccard.clashes(rows.where("doc_id > 1")) is None


def test_points_bound_the_overlap_at_every_size():
    rng = random.Random(12)
    for _ in range(400):
        n = rng.choice([3, 60, 127, 128, 129, 250, 257, 2000])
        s = [rng.getrandbits(64) for _ in range(n)]
        t = s[: n - rng.randrange(n // 5 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(n // 5 + 1))]
        a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (s, t))
        va, vb = (jaccard.unpacked(len(x), jaccard.packed(x)) for x in (a, b))
        for per in (80, 90):
            if jaccard.linked(a, b, per):
                assert jaccard.may_link(len(a), va, len(b), vb, per)
                need_left, need_right = jaccard.near_tiles([(1, len(a), va, 3)], [(2, len(b), vb, 5)], per)
                assert need_left.tolist() == [[0, 5]] and need_right.tolist() == [[0, 3]]


def test_texts_of_templated_documents_are_not_copied(spark):
    """5000 short documents with half their words in common share signatures, but no text goes to a tile."""
    rng = random.Random(3)
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*base, *(f"own{rng.randrange(10**9)}" for _ in range(50))])) for k in range(5000)]
    signed = materialize(jaccard.sets(documents(spark, rows), 5, 80), "sets")
    stars = jaccard.stars_of(signed)
    assert stars.count() >= 4000
    u = [(k, jaccard.shingle_set(t, 5)) for k, t in rows[:2500]]
    points = [(k, len(x), jaccard.count_vector(x, jaccard.dims(len(x))), k // 256) for k, x in u]
    need_left, need_right = jaccard.near_tiles(points[:1250], points[1250:], 80)
    assert len(need_left) + len(need_right) < len(points)
    got = jaccard.join(documents(spark, rows), 5, 80)
    assert got.where("doc_id = component_id").count() == len(rows)
