"""The pipeline's near-duplicate stage: five-word shingles and 0.8, against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from litsieve.llm import jaccard

from .corpus import documents
from .test_jaccard import LOWER, corpus, edited


def shingles(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows):
    own = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(own):
        for b, t in own[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in up}


def test_two_edits_in_a_hundred_words_are_a_near_copy(spark):
    base = [f"w{k}" for k in range(100)]
    near = [*base[:30], "x", *base[31:70], "y", *base[71:]]
    docs = documents(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, "something else altogether here now")])
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 3]
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}[2] == 2  # operator 6's own query: 92/104


@pytest.mark.parametrize("seed", [5, 6])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(150)]
    rows = corpus(seed) + [(5000 + k, " ".join(edited(rng, base, rng.randrange(6)))) for k in range(80)]
    got = {r.doc_id: r.component_id for r in jaccard.join(documents(spark, rows), 5, 80).collect() if r.doc_id is not None}
    assert got == components(rows)


def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = components([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in first if first[i] == i)


@pytest.mark.parametrize("per_100", [80, 90])
def test_linked_sets_share_a_signature(per_100):
    rng = random.Random(per_100)
    odd, found = 100 - per_100, 0
    for _ in range(3000):
        n = rng.choice([rng.randrange(1, 30), rng.randrange(1, 600)])
        s = [rng.getrandbits(64) for _ in range(n)]
        t = s[: n - rng.randrange(n * odd // 100 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(n * odd // 150 + 1))]
        a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (s, t))
        if len(a) and len(b) and jaccard.linked(a, b, per_100) and jaccard.node_of(a) != jaccard.node_of(b):
            found += 1
            assert set(jaccard.signatures(a, per_100).tolist()) & set(jaccard.signatures(b, per_100).tolist())
    assert found > 500
