"""Density clusters and hierarchies of whole tables against the local ones."""

import random

import numpy as np
import pytest

from litsieve.operators import cluster, density


def table(spark, x, keys=None):
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(keys if keys is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def expected(x, keys, eps, least):
    """Clusters by smallest core key; border rows by their smallest core neighbour."""
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = cluster.dbscan(x, eps, least)
    names = {k: min(keys[i] for i in range(len(x)) if core[i] and label[i] == k) for k in set(label[core].tolist())}
    out = []
    for i in range(len(x)):
        if core[i]:
            out.append((keys[i], names[label[i]]))
            continue
        on = [j for j in range(len(x)) if near[i, j] and core[j]]
        out.append((keys[i], names[label[min(on, key=lambda j: keys[j])]] if on else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("dims,eps,least,block", [(1, 0.05, 3, 7), (2, 0.12, 4, 2000), (2, 0.12, 4, 11), (6, 0.9, 5, 40)])
def test_density_equals_local(spark, dims, eps, least, block):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.25 if dims > 2 else 0.05, (40, dims)) for c in (0.0, 0.4, 1.5)] + [rng.uniform(-1, 3, (40, dims))])
    keys = rng.permutation(len(x)).tolist()
    got = density.dbscan_table(table(spark, x, keys), "id", "v", eps, least, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == expected(x, keys, eps, least)


def test_density_of_odd_rows(spark):
    rows = [(k, [0.0, 0.0]) for k in range(300)] + [(500, None), (None, [0.0, 0.0]), (501, []), (502, [float("nan"), 0.0]), (503, [9.0, 9.0]), (503, [9.0, 9.0]), (504, [1.0, None])]
    got = density.dbscan_table(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.1, 3, block=50).collect()
    assert sorted((r["id"], r["cluster"]) for r in got if r["id"] != 503) == [(k, 0) for k in range(300)]
    assert [r["cluster"] for r in got if r["id"] == 503] == [None, None]
    assert density.dbscan_table(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0.1, 3).collect() == []


def test_spanning_links_join_what_is_near():
    rng = random.Random(2)
    for own in (True, False):
        for _ in range(40):
            n, m = rng.randrange(1, 9), rng.randrange(1, 9)
            m = n if own else m
            near = np.array([[rng.random() < 0.2 for _ in range(m)] for _ in range(n)])
            if own:
                near = near | near.T | np.eye(n, dtype=bool)
            links = list(density._forest(near, own))
            name = lambda side, k: k if own else (side, k)  # noqa: E731, B023
            every = {frozenset((name(0, i), name(1, j))) for i in range(n) for j in range(m) if near[i, j] and name(0, i) != name(1, j)}
            some = {frozenset((name(0, i), name(1, j))) for i, j in links}
            assert some <= every and len(links) <= n + m and components(every) == components(some)


def components(edges):
    out = []
    for e in edges:
        hit = [g for g in out if g & e]
        out = [g for g in out if not g & e] + [frozenset().union(e, *hit)]
    return set(out)


def blobs(n, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 6, n)
    return at, np.eye(6)[at] * 4 + rng.normal(0, 0.4, (n, 6))


def test_hierarchy_of_few_rows_is_wards(spark):
    _, x = blobs(300)
    got = {r["id"]: r["cluster"] for r in density.hierarchy_table(table(spark, x), "id", "v", 9).collect()}
    assert cluster.adjusted_rand(np.array([got[k] for k in range(300)]), cluster.agglomerate(x, 9)) == 1.0


def test_hierarchy_from_features(spark):
    at, x = blobs(3000, 1)
    df = table(spark, x).repartition(12)
    points = density._points(df, "id", "v")
    sizes, centres = density.clustering_features(points, leaves=120, fan=3)
    assert len(sizes) <= 120 and sizes.sum() == 3000 and np.allclose((sizes[:, None] * centres).sum(axis=0), x.sum(axis=0))
    got = {r["id"]: r["cluster"] for r in density.hierarchy_table(df, "id", "v", 6, leaves=120).collect()}
    label = np.array([got[k] for k in range(3000)])
    assert cluster.adjusted_rand(label, at) > 0.98 and cluster.adjusted_rand(label, cluster.agglomerate(x, 6)) > 0.98


def test_copies_are_one_feature_and_nothing_is_nothing(spark):
    rows = [(k, [1.0, 2.0]) for k in range(500)] + [(k, [5.0, 5.0]) for k in range(500, 520)] + [(600, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in density.hierarchy_table(df, "id", "v", 2).collect()}
    assert len(got) == 520 and {got[k] for k in range(500)} != {got[k] for k in range(500, 520)}
    assert density.hierarchy_table(df.limit(0), "id", "v", 2).collect() == []
