"""The kernel machine against an exact kernel solver, multi-class boosting against plain numpy, and all seven classifiers together."""

import numpy as np
import pytest

from litsieve.operators import learners, relevance


def rings(n, seed):
    """Three classes that no line divides."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    r, a = 1.0 + y + rng.normal(0, 0.22, n), rng.uniform(0, 2 * np.pi, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), y


def frame(spark, x, y):
    from pyspark.ml.linalg import Vectors

    return spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], ["id", "features", "y"])


def exact_kernel(x, y, test, c=1.0, rounds=60):
    """One-against-rest margins in the dual, coordinate by coordinate, over the whole kernel matrix (with a constant for the offset)."""
    gamma = 1 / (x.shape[1] * x.var())
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) + 1
    k, out = kernel(x, x), []
    for cls in range(3):
        t = np.where(y == cls, 1.0, -1.0)
        alpha, f = np.zeros(len(x)), np.zeros(len(x))
        for _ in range(rounds):
            for i in range(len(x)):
                new = min(max(alpha[i] + (1 - t[i] * f[i]) / k[i, i], 0), c)
                f += (new - alpha[i]) * t[i] * k[i]
                alpha[i] = new
        out.append(kernel(test, x) @ (alpha * t))
    return np.argmax(out, axis=0)


def probabilities(model, df):
    rows = model.transform(df).select("id", "probability").collect()
    return np.array([r["probability"].toArray() for r in sorted(rows, key=lambda r: r["id"])])


def test_kernel_machine(spark):
    (x, y), (tx, ty) = rings(360, 1), rings(300, 2)
    p = probabilities(learners.KernelMachine(components=256, max_iter=30).fit(frame(spark, x, y)), frame(spark, tx, ty))
    exact = (exact_kernel(x, y, tx) == ty).mean()
    assert exact > 0.85 and abs((p.argmax(axis=1) == ty).mean() - exact) <= 0.02
    assert np.allclose(p.sum(axis=1), 1)
    sure = p.max(axis=1) > 0.8
    assert sure.mean() > 0.3 and (p.argmax(axis=1) == ty)[sure].mean() > 0.8


def test_boosting(spark):
    (x, y), (tx, ty) = rings(360, 3), rings(200, 4)
    model = learners.SoftmaxBoosting(rounds=6, depth=4, rate=0.4).fit(frame(spark, x, y))
    p = probabilities(model, frame(spark, tx, ty))
    assert (p.argmax(axis=1) == ty).mean() > 0.7 and np.allclose(p.sum(axis=1), 1)
    loss = [-np.log(np.exp(z)[np.arange(len(y)), y] / np.exp(z).sum(axis=1)).mean() for z in (learners.SoftmaxModel(model.start, model.rounds[:k]).scores(x) for k in range(7))]
    assert all(b < a for a, b in zip(loss, loss[1:], strict=False))
    # the first round's leaf values are Newton steps
    for k, (tree, values) in enumerate(model.rounds[0]):
        r = (y == k) - 1 / 3
        at = tree.places(x)
        for leaf, v in values.items():
            own = r[at == leaf]
            assert v == pytest.approx(0.4 * 2 / 3 * own.sum() / (np.abs(own) * (1 - np.abs(own))).sum())


def test_all_seven_give_rows_for_every_document(spark):
    x, y = rings(90, 5)
    data = frame(spark, x, y).selectExpr("id", "features", "CASE WHEN id % 10 = 9 THEN 'unknown' WHEN y = 0 THEN 'relevant' WHEN y = 1 THEN 'irrelevant' ELSE 'borderline' END AS label")
    preds, metrics = relevance.cross_validate(data, "id", k=2, bags=1, trees=2)
    assert {r["classifier"]: r["n"] for r in preds.groupBy("classifier").count().withColumnRenamed("count", "n").collect()} == dict.fromkeys(relevance.classifiers(), 90)
    assert metrics.count() == 7
