"""Spectral groups of all rows: the dense method where landmarks are all rows, planted groups beyond."""

import math

import numpy as np
import pytest

from litsieve.operators import cluster, spectral


def rings(rng, n, parts):
    """Planted groups: ``parts`` clouds, far apart."""
    mid = 6 * rng.normal(size=(parts, 5))
    which = rng.integers(parts, size=n)
    return mid[which] + rng.normal(size=(n, 5)), which


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "other", 5) for i, v in enumerate(x)], "id long, v array<double>, key string, vector int")


def agreement(a, b):
    """The share of pairs of rows on which two groupings agree."""
    return float(((a[:, None] == a) == (b[:, None] == b)).mean())


@pytest.mark.parametrize("parts", [2, 3, 5])
def test_equals_the_dense_method_if_landmarks_are_all_rows(spark, parts):
    x, _ = rings(np.random.default_rng(parts), 150, parts)
    k, want = cluster.spectral(np.array(cluster.sample_matrix(table(spark, x), "id", "v")[1]))
    ids = cluster.sample_matrix(table(spark, x), "id", "v")[0]
    got = {r.id: r for r in spectral.spectral_table(table(spark, x).repartition(4), "id", "v").collect()}
    assert {r.k for r in got.values()} == {k} and len(got) == 150
    assert agreement(np.array([got[i].label for i in ids]), want) == 1


def test_rows_beyond_the_landmarks(spark):
    x, which = rings(np.random.default_rng(9), 900, 4)
    got = {r.id: r.label for r in spectral.spectral_table(table(spark, x), "id", "v", landmarks=120).collect()}
    assert len(got) == 900 and agreement(np.array([got[i] for i in range(900)]), which) > 0.99


def test_a_landmark_keeps_its_place_and_far_rows_get_one():
    x, _ = rings(np.random.default_rng(4), 80, 3)
    s = spectral.fit_spectrum(x)
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    w = np.exp(-d2 / s.width)
    deg = 1 / np.sqrt(w.sum(axis=1))
    u = np.linalg.eigh(w * deg[:, None] * deg)[1][:, -len(s.centres) :]
    assert np.allclose(s.place(x), u / np.linalg.norm(u, axis=1, keepdims=True), atol=1e-6)
    assert np.isfinite(s.place(np.full((1, 5), 1e5))).all()


def test_odd_rows(spark):
    x, _ = rings(np.random.default_rng(5), 40, 2)
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf] + [0.0] * 4]
    df = table(spark, x).select("id", "v").union(spark.createDataFrame([(100, v) for v in odd] + [(None, x[0].tolist()), (7, x[0].tolist())], "id long, v array<double>"))
    got = spectral.spectral_table(df, "id", "v").collect()
    assert len(got) == 47 and [r.label for r in got if r.id == 100] == [None] * 5
    same = {r.label for r in got if r.id in (0, None)}
    assert len(same) == 1 and same < {r.label for r in got}
    assert spectral.spectral_table(df.limit(0), "id", "v").count() == 0
    assert {(r.label, r.k) for r in spectral.spectral_table(df.where("id < 2"), "id", "v").collect()} == {(0, 1)}
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert {r.label for r in spectral.spectral_table(equal, "id", "v").collect()} == {0}
