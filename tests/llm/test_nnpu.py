"""Operator 8's risk, gradient and sampling against brute force."""

import math
import random

import numpy as np
import pytest

from litsieve.llm import toxicity

from .corpus import documents
from .test_models import labelled


def brute_risk(z, is_p, prior):
    plus = lambda x: math.log1p(math.exp(-x))
    minus = lambda x: math.log1p(math.exp(x))
    p, u = [x for x, own in zip(z, is_p) if own], [x for x, own in zip(z, is_p) if not own]
    first = prior * sum(map(plus, p)) / len(p)
    rest = sum(map(minus, u)) / len(u) - prior * sum(map(minus, p)) / len(p)
    return first, rest


@pytest.mark.parametrize("seed", range(8))
def test_risk_and_its_step(seed):
    rng = np.random.default_rng(seed)
    n = 12
    is_p = np.arange(n) < 5
    z = rng.normal(0, 3, n) + (8 if seed % 2 else -4) * is_p
    prior = 0.6 if seed % 2 else 0.2
    got, g = toxicity.risk(z, is_p, prior)
    first, rest = brute_risk(z, is_p, prior)
    assert got == pytest.approx(first + max(0, rest))
    whole = lambda x: sum(brute_risk(x, is_p, prior)) if rest >= 0 else -brute_risk(x, is_p, prior)[1]
    for k in range(n):
        step = np.zeros(n)
        step[k] = 1e-5
        assert g[k] == pytest.approx((whole(z + step) - whole(z - step)) / 2e-5, abs=1e-6)


def test_both_sides_of_the_clamp_occur():
    is_p = np.array([True, False])
    assert brute_risk([9.0, -9.0], is_p, 0.5)[1] < 0 <= brute_risk([-2.0, 1.0], is_p, 0.5)[1]
    _, g = toxicity.risk(np.array([9.0, -9.0]), is_p, 0.5)
    assert g[0] > 0 > g[1]  # the step goes against the part that fell below zero


def test_gradient_by_weights_equals_differences():
    rng = random.Random(1)
    docs = [(k % 3 == 0, " ".join(sorted({rng.choice(["ab", "abc", "zorku", "zorkum", "q"]) for _ in range(3)}))) for k in range(9)]
    bags = toxicity.Bags(docs)
    is_p = np.array([p for p, _ in docs])
    theta = np.random.default_rng(2).normal(0, 0.5, toxicity.DIMENSIONS)
    z, pooled, e = bags.logits(theta, 0.3)
    _, g = toxicity.risk(z, is_p, 0.3)
    grad = bags.gradient(g, pooled, e)
    for k in rng.sample(sorted(set(bags.f_flat.tolist())), 12):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        value = lambda t: toxicity.risk(bags.logits(t, 0.3)[0], is_p, 0.3)[0]
        assert grad[k] == pytest.approx((value(up) - value(down)) / 2e-5, abs=1e-6)


def test_logits_equal_scores():
    docs = [(True, "zorkum abc"), (False, "abc d"), (False, "")]
    model = toxicity.fit(docs, 0.4, steps=5)
    z, _, _ = toxicity.Bags(docs).logits(model.theta, model.bias)
    assert [model.score(w) for _, w in docs] == pytest.approx((1 / (1 + np.exp(-z))).tolist(), rel=1e-5)


def test_repeated_ids_give_one_row_and_held_out_rows_none(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(2, "b"), (3, "c"), (4, None), (7, "g")]
    got, prior = toxicity.training_rows(documents(spark, rows), labelled(spark, [(i, 1, i % 2) for i in (1, 1, 2, 3, 4, 7)]))
    import zlib

    allowed = [i for i in (1, 2, 3, 4, 7) if zlib.crc32(str(i).encode()) % 5]
    assert len(got) == len(allowed) + sum(i % 2 for i in allowed)
    assert prior == sum(i % 2 for i in allowed) / len(allowed)
    with pytest.raises(ValueError):
        toxicity.training_rows(documents(spark, rows), labelled(spark, [(1, 1, 1)]), use=(0,))
