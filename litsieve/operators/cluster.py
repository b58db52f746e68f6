"""Clustering of the text space.

Point-wise work stays in Spark. What is quadratic in a bounded number of clusters, or a fit on a
bounded sample (``SAMPLE`` rows), is numpy on the driver or in one task for each ensemble run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.vectors import cosine, dot, mean_vector, squared_distance
from litsieve.operators.graph import components_at, connected_components, local_clustering, minimum_spanning_forest
from litsieve.schema import numbered
from litsieve.storage import bounded, materialize

SAMPLE, SOLO = 2000, 999
#: Tasks that share the distances of all classes.
PARTS = 64

# --- small numpy kernels ------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50, restarts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from k-means++ seeds: ``(labels, centres)``; of several starts the one of the least cost."""
    if restarts > 1:
        runs = [kmeans(x, k, seed + 1000 * r, rounds) for r in range(restarts)]
        return min(runs, key=lambda r: float(((x - r[1][r[0]]) ** 2).sum()))
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = near.sum()
        centres.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    label = np.zeros(len(x), dtype=int)
    for turn in range(rounds):
        new = _squared(x, c).argmin(axis=1)
        if turn and (new == label).all():
            break
        label = new
        for j in range(k):
            if (own := label == j).any():
                c[j] = x[own].mean(axis=0)
    return label, c


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def merges(x: np.ndarray, linkage: str = "ward", sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All merges ``(height, i, j)`` of agglomerative clustering, lowest first, by nearest-neighbour chains.

    Lance-Williams updates for ward, complete, average and single linkage; quadratic in the (bounded) rows. i and j are any
    rows of the groups that merge. ``sizes``: how many rows each row stands for, one if not given.
    """
    n = len(x)
    d = _squared(x, x)
    size, alive = np.ones(n) if sizes is None else np.array(sizes, dtype=float), np.ones(n, dtype=bool)
    if linkage != "ward":
        d = np.sqrt(d)
    elif sizes is not None:
        d *= 2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    np.fill_diagonal(d, np.inf)
    out: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            row = d[chain[-1]]
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        a, b, h = d[i].copy(), d[j].copy(), d[i, j]
        if linkage == "ward":
            new = ((size[i] + size) * a + (size[j] + size) * b - size * h) / (size[i] + size[j] + size)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "single":
            new = np.minimum(a, b)
        else:
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        out.append((float(h), i, j))
    return sorted(out, key=lambda m: m[0])


def cut(done: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k groups."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for _, i, j in done[: n - max(k, 1)]:
        up[find(i)] = find(j)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def agglomerate(x: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Labels of k groups (ward, complete, average, single)."""
    return cut(merges(x, linkage), len(x), k)


def dbscan(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels with -1 for noise."""
    near = _squared(x, x) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(len(x), -1)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = k
        while todo:
            p = todo.pop()
            if core[p]:
                fresh = np.flatnonzero(near[p] & (label < 0))
                label[fresh] = k
                todo += fresh.tolist()
        k += 1
    return label


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette (euclidean); 0 where there is one cluster only."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2 or len(names) >= len(x):
        return 0.0
    d = np.sqrt(_squared(x, x))
    sums = np.stack([d[:, at == j].sum(axis=1) for j in range(len(names))], axis=1)
    n = np.bincount(at)
    own = n[at]
    a = np.divide(sums[np.arange(len(x)), at], own - 1, out=np.zeros(len(x)), where=own > 1)
    mean = sums / n
    mean[np.arange(len(x)), at] = np.inf
    b = mean.min(axis=1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def calinski_harabasz(x: np.ndarray, label: np.ndarray) -> float:
    names, at = np.unique(label, return_inverse=True)
    k, n = len(names), len(x)
    if k < 2 or k >= n:
        return 0.0
    c = np.array([x[at == j].mean(axis=0) for j in range(k)])
    within = ((x - c[at]) ** 2).sum()
    between = (np.bincount(at)[:, None] * (c - x.mean(axis=0)) ** 2).sum()
    return float(between / max(within, 1e-300) * (n - k) / (k - 1))


def bic(n: int, d: int, sizes: list[int], cost: float) -> float:
    """V9 from cluster sizes and the summed squared distances; higher is better."""
    m = len(sizes)
    if n <= m:
        return -math.inf
    variance = max(cost / (n - m) / d, 1e-300)
    body = sum(s * math.log(s) - s * math.log(n) - s * d / 2 * math.log(2 * math.pi * variance) - (s - 1) * d / 2 for s in sizes if s)
    return body - 0.5 * m * math.log(n) * (d + 1)


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """V14."""
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, x, y = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected = x * y / max(len(a) * (len(a) - 1) / 2, 1)
    top = (x + y) / 2
    return 1.0 if top == expected else float((both - expected) / (top - expected))


def knee(x: list[float], y: list[float], curve: str = "concave", direction: str = "increasing") -> float | None:
    """Kneedle (Satopaa et al.): the x of the largest distance from the chord; none for a flat curve."""
    a, b = np.asarray(x, float), np.asarray(y, float)
    if len(a) < 3 or a.max() == a.min() or b.max() == b.min():
        return None
    a, b = (a - a.min()) / (a.max() - a.min()), (b - b.min()) / (b.max() - b.min())
    if direction == "decreasing":
        b = b[::-1] if curve == "concave" else 1 - b
    gap = b - a if curve == "concave" or direction == "decreasing" else a - b
    if direction == "decreasing" and curve == "concave":
        gap = gap[::-1]
    k = int(np.argmax(gap))
    return float(x[k]) if gap[k] > 1e-12 else None


def myround(x: float, base: int = 5) -> int:
    """X7."""
    return int(base * round(float(x) / base))


def adaptive_percentile(n: int, k: int, groupings: int) -> float:
    """Which percentile of distances the first threshold is."""
    base = 40.0 if n <= 2 else 100 / (1 + math.exp(-math.log(math.log(n))))
    share = 15 * math.log(k) / math.log(n) if n > 1 else 0.0
    value = base + share + 2.5 * math.log(groupings) / math.log(50)
    return 100 - min(max(value, 0.5), 99.5)


def assignment_quantile(n: int) -> float:
    """X6."""
    return min(max(1 / math.log10(n * n), 0.05), 0.5) if n > 1 else 0.5


# --- choosing k (V10-V15) -----------------------------------------------------------------------------


def sample_matrix(df: DataFrame, key: str, vector: str, limit: int = SAMPLE) -> tuple[list, np.ndarray]:
    """At most ``limit`` rows by a hash of their key, for fits on the driver."""
    rows = df.select(key, vector).orderBy(F.xxhash64(key), key).limit(limit).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)


def scan_k(x: np.ndarray, low: int, high: int, step: int = 5, metric: str = "bic", seed: int = 0) -> int:
    """The best k of a range by ``bic``, ``sil`` or ``cal``."""
    if metric not in ("bic", "sil", "cal"):
        raise ValueError(f"unknown metric {metric}")
    best, at = -math.inf, low
    for k in range(low, min(high, len(x) - 1) + 1, step):
        label, c = kmeans(x, k, seed)
        cost = float(((x - c[label]) ** 2).sum())
        v = bic(len(x), x.shape[1], np.bincount(label, minlength=k).tolist(), cost) if metric == "bic" else silhouette(x, label) if metric == "sil" else calinski_harabasz(x, label)
        if v > best:
            best, at = v, k
    return at


def kmeans_table(df: DataFrame, vector: str, ks: list[int], seed: int = 0) -> DataFrame:
    """V9, V10 over all rows: ``k, bic, silhouette, cost`` of MLlib's k-means for each k; nothing but k centres is collected."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    x = materialize(df.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features")), "vectors")
    n = x.count()
    rows = []
    for k in [k for k in ks if 1 < k < n]:
        model = KMeans(k=k, seed=seed, initMode="k-means||").fit(x)
        sizes, cost = model.summary.clusterSizes, float(model.summary.trainingCost)
        sil = ClusteringEvaluator().evaluate(model.transform(x)) if len([s for s in sizes if s]) > 1 else 0.0
        rows.append((k, bic(n, len(model.clusterCenters()[0]), sizes, cost), float(sil), cost))
    return spark.createDataFrame(rows, "k int, bic double, silhouette double, cost double")


def repeat_scan(x: np.ndarray, low: int, high: int, times: int = 10, **kw) -> list[int]:
    """V11."""
    return [scan_k(x, low, high, seed=s, **kw) for s in range(times)]


def k_adaptive(x: np.ndarray, metric: str = "bic", times: int = 5) -> int:
    """Median over runs in [max(2, sqrt(n)/2), min(2 sqrt(n), n/2)]; the mean where the median is 3 or less."""
    n = len(x)
    low, high = max(2, int(math.sqrt(n) / 2)), max(2, int(min(2 * math.sqrt(n), n / 2)))
    found = repeat_scan(x, low, high, times, metric=metric)
    mid = float(np.median(found))
    return math.ceil(np.mean(found) if mid <= 3 else mid)


def k_elbow(x: np.ndarray, seed: int = 0, high: int = 20) -> int:
    """The knee of the smoothed silhouette over k; without one, the largest silhouette."""
    ks = list(range(2, min(high, len(x) - 1) + 1))
    if not ks:
        return 1
    raw = np.array([silhouette(x, kmeans(x, k, seed)[0]) for k in ks])
    smooth = np.convolve(np.pad(raw, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
    at = knee(ks, smooth.tolist())
    return int(at) if at is not None else ks[int(raw.argmax())]


def k_elbow_sampled(x: np.ndarray, times: int = 20) -> int:
    return math.ceil(np.median([k_elbow(x, s) for s in range(times)]))


def k_consensus(x: np.ndarray, high: int = 10) -> int:
    """The k at which k-means, ward and complete linkage agree best (median adjusted Rand)."""
    best, at = -math.inf, 2
    ward, complete = merges(x, "ward"), merges(x, "complete")
    for k in range(2, min(high, len(x) - 1) + 1):
        a, b, c = kmeans(x, k)[0], cut(ward, len(x), k), cut(complete, len(x), k)
        v = float(np.median([adjusted_rand(a, b), adjusted_rand(a, c), adjusted_rand(b, c)]))
        if v > best:
            best, at = v, k
    return at


def choose_k(x: np.ndarray, n: int | None = None) -> int:
    """V15 over the size of the whole table; never under ``log2(n) * e``."""
    n = n or len(x)
    if n >= 1_000_000:
        k = k_adaptive(x)
    elif n >= 10_000:
        k = k_elbow_sampled(x, 20)
    else:
        three = [k_adaptive(x), k_elbow(x), k_consensus(x)]
        mid = float(np.median(three))
        k = math.ceil(np.mean(three) if mid <= 3 else mid)
    return int(max(k, math.log2(max(n, 2)) * math.e))


# --- ensemble and edit-distance graph (V16-V21) ------------------------------------------------------------


def eps_of(x: np.ndarray, factor: float = 0.7) -> float:
    """The first eps: a share of the median distance to the nearest other row."""
    near = np.sort(_squared(x, x), axis=1)[:, min(1, len(x) - 1)]
    return factor * float(np.median(np.sqrt(near)))


def schedule(g: int, runs: int, k: int, eps: float) -> tuple[float, int, str, int]:
    """Run g's eps (a tenth more for each five runs), core size (2 to 6), linkage, and k (80 % to 120 % over the runs)."""
    return eps * (1 + 0.1 * (g // 5)), 2 + g % 5, ("ward", "complete", "average", "single")[g % 4], max(2, int(k * (0.8 + 0.4 * g / runs)))


def ensemble(df: DataFrame, key: str, vector: str, k: int, runs: int = 50, keep: float = 0.65, noise: float = 0.01, eps_factor: float = 0.7, restarts: int = 1) -> DataFrame:
    """``key, labels`` of every row: for each run k-means, DBSCAN and agglomerative labels on random features with noise.

    Runs are independent tasks over one bounded matrix (``SAMPLE`` rows at most, by a hash of the key, are fitted). Every
    other row takes all labels of its nearest fitted row, found by one pass of matrix products over the table. Rows without a
    vector are left out; repeated keys are each labelled.
    """
    spark = df.sparkSession
    ids, x = sample_matrix(df.where(F.col(vector).isNotNull()), key, vector)
    if not len(ids):
        return df.limit(0).select(key, F.array().cast("array<int>").alias("labels"))
    shared = spark.sparkContext.broadcast(x)  # SAMPLE rows at most

    def run(parts):
        full = shared.value
        n, d = full.shape
        first = eps_of(full, eps_factor)
        for pdf in parts:
            for g in pdf["id"]:
                g = int(g)
                rng = np.random.default_rng(g)
                use = np.flatnonzero(rng.random(d) < keep)
                use = use if len(use) else np.arange(d)
                y = full[:, use] + rng.normal(0, noise, (n, len(use)))
                eps, core, link, kk = schedule(g, runs, k, first)
                found = dbscan(y, eps, core)
                found[found < 0] = found.max() + 1  # noise is a label of its own
                sets = (kmeans(y, min(k, n), g, 20, restarts)[0], found, agglomerate(y, min(kk, n), link))
                yield pd.DataFrame({"row": np.tile(np.arange(n), 3), "run": np.repeat([3 * g, 3 * g + 1, 3 * g + 2], n), "label": np.concatenate(sets)})

    long = spark.range(0, runs, 1, runs).mapInPandas(run, "row long, run long, label long").toPandas()  # SAMPLE rows times three labels a run
    table = np.zeros((len(ids), 3 * runs), dtype=np.int32)
    table[long["row"], long["run"]] = long["label"]
    labels = spark.sparkContext.broadcast(table)
    own = spark.sparkContext.broadcast({v: i for i, v in reversed(list(enumerate(ids)))})

    def assign(parts):
        full, at, mine = shared.value, labels.value, own.value
        for pdf in parts:
            if len(pdf):
                near = _squared(np.array(pdf["v"].tolist(), dtype=float), full).argmin(axis=1)
                rows = [mine.get(i, j) for i, j in zip(pdf[key], near.tolist(), strict=True)]
                yield pd.DataFrame({key: pdf[key], "labels": [at[j].tolist() for j in rows]})

    kind = df.schema[key].dataType.simpleString()
    given = df.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return given.mapInPandas(assign, f"{key} {kind}, labels array<int>")


def label_string(labels: Column) -> Column:
    """Labels as one character each, every label its own, for edit distances."""
    return F.decode(F.unhex(F.array_join(F.transform(labels, lambda v: F.lpad(F.hex((v + 257).cast("long")), 8, "0")), "")), "UTF-32")


def label_classes(labelled: DataFrame, key: str, labels: str = "labels") -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: ``key, first`` of every row, and ``key, labels, size`` of each distinct label list by its first row.

    Rows that take a fitted row's labels are of its class, so there are at most ``SAMPLE`` classes and pairs are made of
    classes only.
    """
    rows = materialize(labelled.select(key, labels), "labels")
    classes = materialize(rows.groupBy(labels).agg(F.min(key).alias(key), F.count("*").alias("size")).select(key, labels, "size"), "classes")
    members = rows.join(classes.select(labels, F.col(key).alias("first")), labels).select(key, "first")
    return members, classes


def edit_distances(df: DataFrame, key: str, labels: str, limit: float | None = None) -> DataFrame:
    """``a < b, dist``: normalised edit distance of label strings; rows are classes (``label_classes``), which are bounded.

    Pairs stay an edge list. With ``limit`` the distance is cut off early and larger ones are left out.
    """
    s = df.select(key, label_string(F.col(labels)).alias("s"))
    p, q = s.select(F.col(key).alias("a"), F.col("s").alias("x")), s.select(F.col(key).alias("b"), F.col("s").alias("y"))
    long = F.greatest(F.length("x"), F.length("y"))
    # the classes are one small file: dealt out, else one task computes all distances
    pairs = p.repartition(PARTS, "a").join(F.broadcast(q), F.col("a") < F.col("b"))
    out = pairs.select("a", "b", F.when(long == 0, 0.0).otherwise(F.levenshtein("x", "y") / long).alias("dist"))
    return out.where(F.col("dist") < limit) if limit is not None else out


def class_edges(members: DataFrame, key: str) -> DataFrame:
    """``a, b, dist``: every further row of a class with its first one, at distance 0."""
    return members.where(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("dist"))


def distance_threshold(pairs: DataFrame, percentile: float, many: str | None = None) -> float:
    """Percentile of distances other than 0 and 1; ``many`` names the column that says how often each row counts."""
    v = pairs.where("dist <> 0 and dist <> 1").agg(F.percentile("dist", F.lit(percentile / 100), F.col(many) if many else 1)).first()[0]
    return 0.5 if v is None else float(v)


def graph_clusters(nodes: DataFrame, pairs: DataFrame, key: str, limit: float) -> DataFrame:
    """``key, cluster`` of components over pairs below the limit, by falling size from 0; alone is 999."""
    comp = materialize(connected_components(pairs.where(F.col("dist") < limit), "a", "b"), "components")
    size = comp.groupBy("component").agg((-F.count("*")).alias("less"))
    order = numbered(size, ["less", "component"], "cluster")  # no window over all components
    order = order.withColumn("cluster", F.when(F.col("cluster") >= SOLO, F.col("cluster") + 1).otherwise(F.col("cluster")).cast("int"))
    return nodes.select(key).join(comp.withColumnRenamed("node", key), key, "left").join(order.select("component", "cluster"), "component", "left").select(key, F.coalesce("cluster", F.lit(SOLO)).alias("cluster"))


# --- fixed values: the method's search range and score
GRID_LOW, GRID_HIGH, GRID_STEP = 0.05, 0.95, 0.025
LARGEST_POWER, OVERSIZE_WEIGHT, SOLO_WEIGHT = 0.6, 10, 2
# ---


def threshold_score(sizes: np.ndarray, solo: int, n: int) -> float | None:
    """V19's score of a clustering; none where it has too few clusters."""
    over, off = np.maximum(0, sizes - n**LARGEST_POWER), sizes - n / math.log(n)
    return _score(len(sizes), float((over**2).sum()), float((off**2).mean()) if len(sizes) else 0.0, solo, n)


def _score(count: int, over: float, off: float, solo: int, n: int) -> float | None:
    if not count or count < math.log(max(n, 3) / 2):
        return None
    return float(math.e * count - (OVERSIZE_WEIGHT * over + off) - (SOLO_WEIGHT * solo if solo else count))


def threshold_scores(pairs: DataFrame, n: int, grid: list[float], sizes: DataFrame | None = None) -> list[float | None]:
    """V19's score of the components at each threshold of the grid, among ``n`` rows in all.

    ``sizes`` (``node, size``) says how many rows each node stands for, one if it is not given. The components of all
    thresholds come from the minimum spanning forest of the pairs and the scores from aggregates of their sizes: one row
    for each threshold reaches the driver.
    """
    forest = materialize(minimum_spanning_forest(pairs.where(F.col("dist") < float(max(grid))), "a", "b"), "forest")
    nodes = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("size", F.lit(1))
    if sizes is not None:
        nodes = sizes.select("node", "size").unionByName(nodes).groupBy("node").agg(F.max("size").alias("size"))
    size = F.col("size").cast("double")
    over, off = F.greatest(F.lit(0.0), size - float(n) ** LARGEST_POWER), size - n / math.log(n)
    found = components_at(forest, nodes, grid).where("size > 1")
    rows = found.groupBy("step").agg(F.count("*").alias("count"), F.sum("size").alias("placed"), F.sum(over * over).alias("over"), F.avg(off * off).alias("off")).collect()
    out: list[float | None] = [None] * len(grid)
    for r in rows:
        out[r["step"]] = _score(r["count"], r["over"], r["off"], n - r["placed"], n)
    return out


def search_threshold(pairs: DataFrame, n: int, first: float, percentile: float, step: float = GRID_STEP, sizes: DataFrame | None = None) -> float:
    """The grid threshold with the best score (the lowest of equal ones); the first one where none is admissible.

    The range comes from a quantile of the distances other than 0 and 1; its upper end is not part of it. ``sizes`` as in
    ``threshold_scores``.
    """
    r = pairs.where("dist <> 0 and dist <> 1").agg(F.percentile("dist", F.lit(min(1.0, percentile / (100 * math.e))))).first()[0] or 0.0
    grid = [float(t) for t in np.arange(max(GRID_LOW, first - r), min(GRID_HIGH, first + r / 3), step)]
    if not grid or n < 2:
        return first
    found = [(v, -k) for k, v in enumerate(threshold_scores(pairs, n, grid, sizes)) if v is not None]
    return grid[-max(found)[1]] if found else first


def ensemble_graph(df: DataFrame, key: str, vector: str, k: int, runs: int, keep: float = 0.65, noise: float = 0.01, step: float = GRID_STEP, eps_factor: float = 0.7, restarts: int = 1) -> tuple[float, DataFrame, DataFrame]:
    """V16 to V19 in turn: the chosen threshold, the classes' distances ``a, b, dist``, and ``key, first`` of every row."""
    members, classes = label_classes(ensemble(df, key, vector, k, runs, keep, noise, eps_factor, restarts), key)
    members = materialize(members, "members")
    pairs = materialize(edit_distances(classes, key, "labels"), "distances")
    n = members.count()
    pct = adaptive_percentile(n, k, runs)
    sizes = classes.select(F.col(key).alias("node"), "size")
    return search_threshold(pairs, n, distance_threshold(pairs, pct), pct, step, sizes), pairs, members


def assign_nearest(points: DataFrame, centroids: DataFrame, vector: str, by: str = "cluster") -> DataFrame:
    """Each point's nearest centroid by cosine, with its similarity; centroids are counted before they are broadcast.

    Every row of ``points`` is a row of its own, also where rows are equal.
    """
    side = bounded(centroids, "centroids")
    named = side.select(F.col(by).alias("nearest"), F.col("centroid").alias("__c"))
    w = points.withColumn("__row", F.monotonically_increasing_id()).crossJoin(named).withColumn("similarity", cosine(F.col(vector), F.col("__c")))
    keys = [c for c in points.columns if c != vector]
    return w.groupBy("__row", *keys).agg(F.max_by(F.struct("nearest", "similarity"), F.struct(F.round("similarity", 12), -F.col("nearest"))).alias("m")).select(*keys, "m.nearest", "m.similarity")


def reassign_solos(df: DataFrame, vector: str, key: str, cluster: str = "cluster") -> DataFrame:
    """Single rows join the nearest cluster if they are closer than the X6 quantile of all such distances."""
    cents = bounded(mean_vector(df.where(F.col(cluster) != SOLO), cluster, vector), "centroids")
    near = assign_nearest(df.where(F.col(cluster) == SOLO).select(key, vector), cents, vector, cluster)
    pairs = df.where(F.col(cluster) == SOLO).crossJoin(cents.select("centroid")).select((1 - cosine(F.col(vector), F.col("centroid"))).alias("d"))
    limit = pairs.agg(F.percentile("d", F.lit(assignment_quantile(df.count())))).first()[0]
    if limit is None:
        return df
    moved = near.where(1 - F.col("similarity") < float(limit)).select(key, F.col("nearest").alias("__to"))
    return df.join(moved, key, "left").withColumn(cluster, F.coalesce("__to", cluster)).drop("__to")


def nearest_neighbour_eps(df: DataFrame, key: str, vector: str) -> float:
    """Median distance to the nearest other row, of a bounded sample."""
    _, x = sample_matrix(df, key, vector)
    d = _squared(x, x)
    np.fill_diagonal(d, np.inf)
    return float(np.sqrt(np.median(d.min(axis=1)))) if len(x) > 1 else 0.0


# --- cluster quality, selection and description (A15-A18, X9, V22-V26, R10-R12) --------------------------------


def cluster_ess(df: DataFrame, vector: str, by: str = "cluster") -> DataFrame:
    """``log10(sum of squared distances to the centroid + 1)``."""
    cents = mean_vector(df, by, vector)
    return df.join(cents, by).groupBy(by).agg(F.log10(F.sum(squared_distance(F.col(vector), F.col("centroid"))) + 1).alias("ess"))


def cluster_silhouette(df: DataFrame, key: str, vector: str, by: str = "cluster") -> DataFrame:
    """One-against-rest silhouette of each cluster on cosine distances.

    On unit vectors mean cosine distances follow from each cluster's vector sum, so no pairs are made:
    the mean to a set S is ``1 - x . sum(S) / |S|``.
    """
    from litsieve.functions.vectors import l2_normalise

    u = df.select(key, by, l2_normalise(F.transform(vector, lambda v: v.cast("double"))).alias("u"))
    per = mean_vector(u, by, "u").select(by, F.transform("centroid", lambda v: v).alias("c"), F.col("size").alias("n"))
    whole = u.withColumn("__all", F.lit(0))
    total = mean_vector(whole, "__all", "u").select(F.col("centroid").alias("t"), F.col("size").alias("m"))
    j = u.join(per, by).crossJoin(F.broadcast(total))
    inside = dot(F.col("u"), F.col("c")) * F.col("n")
    outside = dot(F.col("u"), F.col("t")) * F.col("m") - inside
    own = dot(F.col("u"), F.col("u"))
    a = F.try_divide((F.col("n") - 1) - (inside - own), F.col("n") - 1)
    b = F.try_divide((F.col("m") - F.col("n")) - outside, F.col("m") - F.col("n"))
    s = F.when((F.col("n") < 2) | (F.col("m") == F.col("n")), 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return j.groupBy(by).agg(F.avg(s).alias("silhouette"))


def coherence(stats: DataFrame, by: str = "cluster") -> DataFrame:
    """X9 from ``by, size, ess, silhouette, clustering``: the mean of the four parts, each over the largest of the four."""
    mean = stats.agg(F.avg("size").alias("mean_size"))
    r = F.col("size") / F.col("mean_size")
    s = stats.crossJoin(F.broadcast(mean))
    s = s.withColumns(
        {
            "p_size": F.log1p(F.least(r, 1 / r)),
            "p_ess": F.log1p(F.sqrt("ess")),
            "p_sil": F.log1p(F.greatest("silhouette", F.lit(0.0))),
            "p_graph": F.log1p("clustering"),
        }
    )
    top = F.greatest("p_size", "p_ess", "p_sil", "p_graph")
    return s.withColumn("coherence", F.coalesce(F.try_divide(F.col("p_size") + F.col("p_ess") + F.col("p_sil") + F.col("p_graph"), 4 * top), F.lit(0.0))).drop("p_size", "p_ess", "p_sil", "p_graph", "mean_size")


def mean_clustering(pairs: DataFrame, members: DataFrame, key: str, by: str = "cluster") -> DataFrame:
    """A17 by cluster."""
    c = local_clustering(pairs, "a", "b").withColumnRenamed("node", key)
    return members.join(c, key, "left").groupBy(by).agg(F.avg(F.coalesce("clustering", F.lit(0.0))).alias("clustering"))


def gap_cut(scores: DataFrame, score: str = "score", gap: float = 0.5) -> DataFrame:
    """``above`` marks scores before the first relative gap over ``gap`` in falling order."""
    w = Window.orderBy(F.desc(score))
    g = scores.withColumn("gap", F.try_divide(F.col(score) - F.lead(score).over(w), F.col(score)))
    cut = g.where(F.col("gap") > gap).agg(F.max(score).alias("cut"))
    return g.crossJoin(F.broadcast(cut)).withColumn("above", F.col("cut").isNull() | (F.col(score) >= F.col("cut"))).drop("cut")


def elbow_threshold(scores: list[float], cuts: int = 10) -> float:
    """The knee of how many scores lie over each of the cuts; the last cut where there is none."""
    if not scores:
        return 0.0
    at = np.linspace(min(scores), max(scores), cuts)
    n = [int(sum(s >= t for s in scores)) for t in at]
    found = knee(at.tolist(), n, "convex", "decreasing")
    return float(at[-1] if found is None else found)


def merge_pairs(centroids: DataFrame, by: str = "cluster", percentile: float = 0.9) -> DataFrame:
    """V24's candidates: ``a < b, similarity`` at or over the percentile of similarities below 1."""
    a = centroids.select(F.col(by).alias("a"), F.col("centroid").alias("x"))
    b = centroids.select(F.col(by).alias("b"), F.col("centroid").alias("y"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("x"), F.col("y")).alias("similarity"))
    limit = pairs.where("similarity < 1").agg(F.percentile("similarity", F.lit(percentile)).alias("limit"))
    return pairs.crossJoin(F.broadcast(limit)).where("similarity >= limit").drop("limit")


def greedy_merges(pairs: DataFrame) -> list[tuple]:
    """Best pairs first, each cluster once; clusters are tens, so this is a loop on the driver."""
    used, out = set(), []
    for r in pairs.orderBy(F.desc("similarity"), "a", "b").collect():
        if r.a not in used and r.b not in used:
            used |= {r.a, r.b}
            out.append((r.a, r.b))
    return out


def merged_clusters(info: DataFrame, merges: list[tuple], scores: DataFrame, by: str = "cluster") -> DataFrame:
    """``merged_a_b`` rows: plain mean centroid, concatenated titles and members, mean score.

    ``info``: ``by, centroid, titles, members``; sizes are plain (D22).
    """
    spark = info.sparkSession
    m = spark.createDataFrame([(f"merged_{a}_{b}", str(c)) for a, b in merges for c in (a, b)], f"name string, {by} string")
    j = info.withColumn(by, F.col(by).cast("string")).join(m, by).join(scores.select(F.col(by).cast("string").alias(by), "score"), by)
    cent = mean_vector(j, "name", "centroid").select("name", "centroid")
    rest = j.groupBy("name").agg(F.flatten(F.collect_list("titles")).alias("titles"), F.flatten(F.collect_list("members")).alias("members"), F.avg("score").alias("score"))
    return rest.join(cent, "name").select(F.col("name").alias(by), "centroid", "titles", "members", "score")


def select_clusters(info: DataFrame, scores: DataFrame, by: str = "cluster", cuts: int = 10, percentile: float = 0.9) -> DataFrame:
    """Clusters over the elbow of ``cuts`` cuts stay; low ones that merge (pairs from the percentile on) stay if the merged score passes a new elbow."""
    values = [r[0] for r in scores.select("score").collect()]  # one for each cluster
    small = len(values) <= 5
    if small:
        cut_row = gap_cut(scores.select("score")).where("above").agg(F.min("score")).first()
        limit = float(cut_row[0]) if cut_row and cut_row[0] is not None else 0.0
    else:
        limit = elbow_threshold(values, cuts)
    scored = info.join(scores, by)
    high = scored.where(F.col("score") >= limit)
    low = scored.where(F.col("score") < limit)
    merges = greedy_merges(merge_pairs(low.select(by, "centroid"), by, percentile)) if low.count() > 1 else []
    out = high.select(F.col(by).cast("string").alias(by), "centroid", "titles", "members", "score")
    if not merges:
        return out
    merged = merged_clusters(low.drop("score"), merges, scores, by)
    again = elbow_threshold([r[0] for r in merged.select("score").collect()], cuts)
    return out.unionByName(merged.where(F.col("score") >= again))


def exemplars(df: DataFrame, key: str, vector: str, by: str = "cluster") -> DataFrame:
    """The row nearest its own centroid, and the one nearest the mean of all."""
    cents = mean_vector(df, by, vector).select(by, "centroid")
    whole = mean_vector(df.withColumn("__all", F.lit(0)), "__all", vector).select(F.col("centroid").alias("__g"))
    j = df.join(cents, by).crossJoin(F.broadcast(whole))
    j = j.withColumns({"own": F.round(dot(F.col(vector), F.col("centroid")), 9), "all": F.round(dot(F.col(vector), F.col("__g")), 9)})
    best = lambda c: F.max_by(key, F.struct(c, -F.col(key)))
    return j.groupBy(by).agg(best("own").alias("exemplar"), best("all").alias("most_relevant"))


def representative_sample(df: DataFrame, key: str, vector: str, by: str = "cluster") -> DataFrame:
    """Rows near their centroid (at least .9 or over the median), without clusters of one such row, at most twice the smallest group."""
    cents = mean_vector(df, by, vector).select(by, "centroid")
    j = df.join(cents, by).withColumn("dot", F.round(dot(F.col(vector), F.col("centroid")), 5))
    med = j.groupBy(by).agg(F.round(F.percentile("dot", F.lit(0.5)), 5).alias("med"))
    near = j.join(med, by).where("dot >= 0.9 or dot > med")
    n = near.groupBy(by).agg(F.count("*").alias("n")).where("n > 1")
    least = n.agg((2 * F.min("n")).alias("cap"))
    w = Window.partitionBy(by).orderBy(F.desc("dot"), key)
    return near.join(n.select(by), by).crossJoin(F.broadcast(least)).withColumn("r", F.row_number().over(w)).where("r <= cap").select(key, by, "dot")


# --- exploratory clustering of several similarity matrices (V27-V33) ----------------------------------------


def parafac(tensor: np.ndarray, rank: int, rounds: int = 100, seed: int = 0) -> list[np.ndarray]:
    """CP decomposition by alternating least squares, factors of unit columns."""
    rng = np.random.default_rng(seed)
    f = [rng.random((s, rank)) for s in tensor.shape]
    last = math.inf
    for _ in range(rounds):
        for m in range(3):
            a, b = [f[k] for k in range(3) if k != m]
            kr = np.einsum("ir,jr->ijr", a, b).reshape(-1, rank)
            unfolded = np.moveaxis(tensor, m, 0).reshape(tensor.shape[m], -1)
            f[m] = unfolded @ kr @ np.linalg.pinv((a.T @ a) * (b.T @ b))
            if m < 2:
                f[m] = f[m] / np.maximum(np.linalg.norm(f[m], axis=0), 1e-12)
        error = float(np.linalg.norm(tensor - np.einsum("ir,jr,kr->ijk", *f)))
        if last - error < 1e-8 * max(error, 1):
            break
        last = error
    return f


def similarity_of(distance: np.ndarray) -> np.ndarray:
    """X3 for a matrix."""
    s = 1 / (1 + distance)
    span = s.max() - s.min()
    return (s - s.min()) / span if span else np.zeros_like(s)


def metric_factors(matrices: list[np.ndarray], rank: int) -> np.ndarray:
    """The standardised sample factor of stacked similarity matrices (bounded n)."""
    t = np.stack([similarity_of(m) for m in matrices])
    f = parafac(t, rank)[1]
    return (f - f.mean(axis=0)) / np.maximum(f.std(axis=0), 1e-12)


def ward_sweep(x: np.ndarray, low: int = 2, high: int = 9) -> dict[int, np.ndarray]:
    """V28, V31."""
    return {k: agglomerate(x, k, "ward") for k in range(low, min(high, len(x)) + 1)}


def dbscan_sweep(x: np.ndarray) -> np.ndarray:
    """Eps .05 to .5 by .05, three rows make a core; the last one counts."""
    return [dbscan(x, e, 3) for e in np.arange(0.05, 0.51, 0.05)][-1]


def spectral(x: np.ndarray, low: int = 2, high: int = 9) -> tuple[int, np.ndarray]:
    """Normalised spectral clustering with the k of the best silhouette."""
    d2 = _squared(x, x)
    w = np.exp(-d2 / max(float(np.median(d2)), 1e-12))
    deg = 1 / np.sqrt(w.sum(axis=1))
    _, vec = np.linalg.eigh(w * deg[:, None] * deg[None, :])
    best = (-math.inf, 2, np.zeros(len(x), dtype=int))
    for k in range(low, min(high, len(x) - 1) + 1):
        u = vec[:, -k:]
        label = kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)[0]
        best = max(best, (silhouette(x, label), k, label), key=lambda t: t[0])
    return best[1], best[2]


def metric_clusterings(df: DataFrame, key: str, matrices: list[np.ndarray], ids: list, ranks: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """``key`` and columns ``T{rank}_H{k}``, ``T{rank}_Spec``, ``T{rank}_dbScan`` (D19: ranks 2 to 5)."""
    cols: dict[str, list] = {key: list(ids)}
    for r in ranks:
        x = metric_factors(matrices, r)
        for k, label in ward_sweep(x).items():
            cols[f"T{r}_H{k}"] = label.tolist()
        cols[f"T{r}_Spec"] = spectral(x)[1].tolist()
        cols[f"T{r}_dbScan"] = dbscan_sweep(x).tolist()
    return df.join(F.broadcast(df.sparkSession.createDataFrame(pd.DataFrame(cols))), key)
