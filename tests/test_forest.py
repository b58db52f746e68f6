"""The minimum spanning forest and what rests on it, against union-find over sorted edges."""

import random

import numpy as np
import pytest

from litsieve.operators import cluster
from litsieve.operators.graph import components_at, minimum_spanning_forest


def union_find(edges):
    """Kruskal over (dist, a, b): the edges it takes."""
    root = {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    taken = []
    for d, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in edges if a is not None and b is not None and d is not None and a != b):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            taken.append((a, b, d))
    return taken


def groups(edges, nodes, limit):
    near = {v: {v} for v in nodes}
    for a, b, d in edges:
        if d < limit and near[a] is not near[b]:
            near[a] |= near[b]
            for v in near[b]:
                near[v] = near[a]
    return {frozenset(s) for s in near.values()}


def graph(rng, n, m, steps):
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(1, steps) / steps) for _ in range(m)]


@pytest.mark.parametrize("n,m,steps", [(1, 3, 5), (12, 8, 100), (40, 200, 4), (60, 59, 1000)])
def test_forest_is_kruskals(spark, n, m, steps):
    edges = graph(random.Random(n), n, m, steps) + [(None, 1, 0.1), (1, None, 0.1), (1, 2, None), (3, 3, 0.0)]
    least = {}
    for a, b, d in edges:
        if None not in (a, b, d):
            key = (min(a, b), max(a, b))
            least[key] = min(d, least.get(key, d))
    want = union_find([(a, b, d) for (a, b), d in least.items()])
    got = minimum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, dist double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long, dist double")
    assert minimum_spanning_forest(none).collect() == []


def test_a_hot_node_and_string_names(spark):
    edges = [("hub", f"n{k}", k / 500) for k in range(500)] + [(f"n{k}", f"n{k + 1}", 0.0005 * k) for k in range(499)]
    got = minimum_spanning_forest(spark.createDataFrame(edges, "src string, dst string, dist double"))
    assert sorted(map(tuple, got.collect())) == sorted(union_find(edges))


def test_components_at_every_limit(spark):
    rng = random.Random(5)
    edges = graph(rng, 30, 60, 20)
    nodes = [(v, 1 + v % 3) for v in range(33)]
    limits = [0.0, 0.05, 0.2, 0.5, 0.99]
    forest = minimum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, dist double"))
    rows = components_at(forest, spark.createDataFrame(nodes, "node long, size int"), limits).collect()
    for k, t in enumerate(limits):
        want = sorted(sum(1 + v % 3 for v in g) for g in groups(edges, range(33), t))
        assert sorted(r["size"] for r in rows if r["step"] == k) == want


def test_scores_are_those_of_each_clustering(spark):
    rng = random.Random(8)
    edges = [(a, b, d) for a, b, d in graph(rng, 40, 120, 50) if a < b]
    edges = [(a, b, d) for (a, b), d in {(a, b): d for a, b, d in edges}.items()]
    size = {v: 1 + (v % 7 == 0) * 3 for v in range(45)}
    n = sum(size.values()) + 4
    grid = [0.05 * k for k in range(1, 15)]
    sizes = spark.createDataFrame(list(size.items()), "node long, size int")
    got = cluster.threshold_scores(spark.createDataFrame(edges, "a long, b long, dist double"), n, grid, sizes)
    for t, v in zip(grid, got, strict=True):
        own = np.array([s for s in (sum(size[x] for x in g) for g in groups(edges, size, t)) if s > 1], dtype=float)
        want = cluster.threshold_score(own, n - int(own.sum()), n)
        assert v == (None if want is None else pytest.approx(want)), t
