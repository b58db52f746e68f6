"""Operator 12 against all periods of all places, and against planted tails."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from litsieve.llm import periodic
from tests.llm.corpus import LONG, ODD, documents, empty


def brute(words, least):
    """Every stretch that repeats at a distance and can't be extended, with its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        t = 0
        while t < len(words) - q:
            s = t
            while t < len(words) - q and words[t] == words[t + q]:
                t += 1
            if t - s + q >= max(least, 2 * q):
                found.setdefault((s, t - s + q), q)
            t = max(t, s + 1) if t == s else t
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def some(rng):
    n = rng.choice([0, 1, 2, 5, 20, 60, 90])
    k = rng.choice([1, 2, 3, 10])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.4:
        a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
        words = words[:a] + [words[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
    return fibonacci(n) if n and rng.random() < 0.1 else words


def same(docs, least):
    got = periodic.runs_of([np.array(d, dtype=np.int64) for d in docs], least)
    for d, g in zip(docs, got, strict=True):
        assert g == brute(d, least), d


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_are_all_runs(least):
    rng = random.Random(least)
    for _ in range(80):
        same([some(rng) for _ in range(6)], least)


def test_a_colliding_hash_changes_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "_PRIME", 7)
    monkeypatch.setattr(periodic.Hashes, "_powers", np.ones(1, dtype=np.int64))
    rng = random.Random(3)
    for _ in range(60):
        same([[rng.randrange(2) for _ in range(rng.choice([5, 40, 80]))] for _ in range(4)], 2)


def test_long_runs_stay_linear():
    got = periodic.runs_of([np.zeros(200_000, dtype=np.int64), np.tile(np.arange(1000), 200)], 12)
    assert got == [[(0, 200_000, 1)], [(0, 200_000, 1000)]]


def expected(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and doc_id is not None and n and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id,
        len(runs),
        *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])),
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_odd_rows(spark):
    rows = [r for r in ODD if r[1] != LONG] + [(11, "a b " * 9), (12, "\x0b a\x0ca\ta\ra " * 4), (13, "x y z " * 4 + "x"), (13, "q " * 11)]
    got = {}
    for r in periodic.detect(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(expected(i, t, False))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert periodic.detect(empty(spark)).count() == 0


def test_whole_query_over_short_documents(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in periodic.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {r[0] for r in docs}
    small = [r for r in docs if len(r[1]) < 4000]
    assert len(small) > 100 and any(got[r[0]][1] for r in small)
    for i, t in small:
        assert got[i] == expected(i, t, True)


def test_collapse_keeps_rows_and_columns(spark):
    docs = documents(spark, [(1, "go " * 30 + "on"), (2, None), (3, "  two  spaces "), (4, "a b c " * 5)])
    out = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert [out[k]["text"] for k in (1, 2, 3, 4)] == ["go on", None, "  two  spaces ", "a b c"]
    assert out[1].asDict().keys() == set(docs.columns)
