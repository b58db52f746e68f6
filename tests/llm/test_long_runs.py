"""Toxic stems behind the 40th letter of one run."""

import random

import numpy as np
import pytest

from litsieve.llm import toxicity

from .test_models import labelled, toxic_corpus  # noqa: F401
from .corpus import documents


def test_pieces_hold_all_of_a_run():
    rng = random.Random(3)
    for n in (1, 3, 11, 12, 13, 39, 40, 41, 60, 1234):
        run = "".join(rng.choice("abcdefghij") for _ in range(n))
        assert toxicity.words(run.upper()) == {run}
        own = ["".join(map(chr, r[:m])) for _, row, many in toxicity.pieces(["pad", run]) for r, m in zip(row.tolist(), many.tolist(), strict=True)]
        assert own[0] == "<pad>" and len(own) == 1 + max(1, n - 3)
        assert own[1].startswith("<" + run[:12]) and own[-1].endswith(">")
        for k in range(n):
            assert any(run[k : k + 12] in p for p in own[1:])


@pytest.mark.parametrize("n", [3, 12, 13, 30, 40, 41, 200])
def test_fit_and_score_pool_alike_at_every_length(n):
    rng = random.Random(n)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(n)) for _ in range(5)) for _ in range(4)]
    theta = np.random.default_rng(n).normal(0, 0.7, toxicity.DIMENSIONS)
    z, _, _ = toxicity.Bags([(False, " ".join(sorted(toxicity.words(t)))) for t in texts]).logits(theta, 0.2)
    model = toxicity.Model(theta, 0.2)
    assert [model.score(t) for t in texts] == pytest.approx((1 / (1 + np.exp(-z))).tolist(), rel=1e-6)


def test_a_stem_behind_letter_40_marks_the_document(spark, toxic_corpus):  # noqa: F811
    rows, labels, _ = toxic_corpus
    docs = documents(spark, rows)
    model = toxicity.train(docs, labelled(spark, labels))
    rng = random.Random(4)
    clean, glued = 0, 0
    for k in range(40):
        run = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(60, 400)))
        at = rng.randrange(45, len(run))
        stem = rng.choice(["zorkum", "quazzle", "vixtra"])
        clean += model.score(run) >= 0.5
        glued += model.score(run[:at] + stem + run[at:]) >= 0.5
    assert clean == 0 and glued == 40
    noise = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1000, 6000))) for _ in range(20)]
    assert sum(model.score(x) >= 0.5 for x in noise) == 0
