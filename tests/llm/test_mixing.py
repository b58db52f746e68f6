"""Operator 11 against targets shared out by hand, the entropy optimum of a plain solver, and the rules of the mix."""

import math
from collections import Counter, defaultdict

import pandas as pd
import pytest

from litsieve.llm import mixing
from tests.llm.corpus import ODD, documents, empty

SCHEMA = "doc_id long, text string, source string, size string, place string, n string, rows string, copies string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", None, "b", "c", None, "d") for i, t, s in rows], SCHEMA)


def shared_out(sizes, factor=1.5, cap=2):
    """Targets by source: what is above twice a source's size is shared again by weight, one round after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), factor * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def optimum(sizes, target, cap=2.0, base=1.0):
    """Rates of least relative entropy, by bisection on the tilt."""
    scale = sum(x * x for x in sizes) / sum(sizes)
    of = lambda t: [cap / (1 + (cap / base - 1) * math.exp(-max(-700, min(700, t * x / scale)))) for x in sizes]
    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(x * r for x, r in zip(sizes, of(mid), strict=True)) < target else (lo, mid)
    return of((lo + hi) / 2)


def words(text):
    return len((text or "").encode().split())


def held(rows, got):
    """The rules: sizes, targets, at most two copies, words near the target."""
    sizes, taken, longest = Counter(), Counter(), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    target = shared_out(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, words(t), s) for i, t, s in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    return taken, target


def test_odd_rows(spark):
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 2}") for k, (i, t) in enumerate(ODD)] + [(70, None, "silent"), (None, "a b", "s1"), (None, "c d", "s1"), (None, "e f", "s1")]
    got = mixing.mix(docs(spark, rows)).collect()
    held(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).select("target", "taken").distinct().collect() == [(0.0, 0)]


def test_words_come_near_each_target(spark):
    rows = [(k, "w " * (1 + k * k % 97), f"src{k % 7}" if k % 2 else "hot") for k in range(3000)] + [(k, "same words here", "hot") for k in range(3000, 5000)]
    taken, target = held(rows, mixing.mix(docs(spark, rows)).collect())
    for s in target:
        assert abs(taken[s] - target[s]) <= 3, s


def test_rates_are_the_entropy_optimum(spark):
    rows = [(k, "w " * (1 + k * k % 97), f"s{k % 4}") for k in range(400)]
    sized = mixing.sized(docs(spark, rows)).groupBy("source", "size").count().withColumnRenamed("count", "n")
    sources = mixing.source_targets(sized)
    tilt = {r["source"]: r for r in sources.join(mixing.tilts(sized.join(sources, "source").select("place", "size", "n"), sources), "place", "left").collect()}
    for s, r in tilt.items():
        own = [words(t) for _, t, x in rows if x == s]
        if r["tilt"] is None:
            assert r["target"] == 2 * sum(own)
            continue
        want = optimum(own, r["target"])
        got = [2 / (1 + math.exp(-r["tilt"] * x / r["scale"])) for x in own]
        assert max(abs(a - b) for a, b in zip(want, got, strict=True)) < 1e-4, s


def test_rounding_carries_what_is_owed():
    group = pd.DataFrame({"place": 0, "size": [1, 5, 100, 40], "n": [50, 10, 1, 3], "rate": [1.1, 1.3, 1.49, 1.7]})
    out = mixing.rounded(group, 2)
    assert abs((out["copies"] * out["size"]).sum() - (group["n"] * group["size"] * group["rate"]).sum()) <= 0.5


def test_the_mix_repeats_documents(spark):
    rows = [(k % 40, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(100)] + [(None, "x y", "a")] * 3
    source = docs(spark, rows)
    got = Counter((r["doc_id"], words(r["text"]), r["source"]) for r in mixing.mixed(source).collect())
    want = Counter()
    for r in mixing.mix(source).collect():
        want[(r["doc_id"], r["size"], r["source"])] += r["copies"]
    assert got == +want and mixing.mixed(source).columns == source.columns


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    taken, target = held(rows, mixing.op11_entropy_mixing(spark, sf).collect())
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 50), s
