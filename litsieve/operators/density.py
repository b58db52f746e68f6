"""Clustering of all rows of a table: density clusters (V16, V29, J13) and hierarchies over clustering features."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.operators.cluster import SAMPLE, _squared, cut, merges, sample_matrix
from litsieve.operators.graph import connected_components
from litsieve.schema import numbered
from litsieve.storage import materialize

#: Rows of one side of a product; parts of the table, of which each row meets all at most; most rows of one part; directions that cells are cut by.
BLOCK, PARTS, LARGEST, DIRECTIONS = 2000, 16, 50_000, 2


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, key, v``: rows with a key and a vector of finite numbers, each with a number of its own."""
    rows = df.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "points")


def _directions(points: DataFrame, how_many: int) -> np.ndarray:
    """Orthogonal directions along which a bounded sample spreads most; any would do, these make the most cells."""
    _, x = sample_matrix(points, "id", "v")
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return vt[:how_many]


def _tiled(points: DataFrame, eps: float, directions: np.ndarray, block: int) -> Callable[..., DataFrame]:
    """Makes ``task, side, id, v`` and the columns of a table by ``id`` that is joined before rows are dealt: pairs of blocks of at most about ``block`` rows whose cells touch; each pair of near rows meets in one task.

    Cells are eps wide in each direction. A projection never lengthens a distance, so rows within eps are in the same cell or
    in touching ones. A full cell is dealt over several blocks by number, so no task holds more than two blocks.
    """
    cell = F.array(*[F.floor(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in d]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / eps) for d in directions])
    t = materialize(points.select("id", "v", cell.alias("cell")), "cells")
    blocks = t.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = materialize(t.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "cell", "block"), "blocks")
    each = materialize(blocks.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "block-list")
    zero = (0,) * len(directions)
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(directions)) if s >= zero]
    step = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in steps])).alias("step")
    left = each.select(F.col("cell").alias("c0"), F.col("block").alias("b0"), step).withColumn("c1", F.zip_with("c0", "step", lambda x, y: x + y))
    met = left.join(each.select(F.col("cell").alias("c1"), F.col("block").alias("b1")), "c1").where((F.col("c0") != F.col("c1")) | (F.col("b0") <= F.col("b1")))
    met = materialize(met.select("c0", "b0", "c1", "b1").withColumn("task", F.monotonically_increasing_id()), "block-pairs")

    def dealt(more: DataFrame | None = None) -> DataFrame:
        rows = placed if more is None else placed.join(more, "id", "left")
        keep = [c for c in rows.columns if c not in ("cell", "block")]
        side = lambda k: rows.join(met.select("task", F.col(f"c{k}").alias("cell"), F.col(f"b{k}").alias("block"), (F.struct("c0", "b0") == F.struct("c1", "b1")).alias("own")), ["cell", "block"])
        return side(0).select("task", F.lit(0).alias("side"), *keep).unionByName(side(1).where("not own").select("task", F.lit(1).alias("side"), *keep))

    return dealt


class _Pair:
    """The two sides of a task (the same one twice where a block meets itself), compared ``BLOCK`` rows of each at a time."""

    def __init__(self, table: pa.Table, eps: float):
        table = table.combine_chunks()
        self.ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        lists = table.column("v").combine_chunks()
        self.x = lists.flatten().to_numpy().reshape(len(side), -1)
        self.own, self.eps = bool((side == 0).all()), eps
        self.first, self.second = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if self.own else 1))

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of either side, by their places, and which of them are near; each two rows once, those of one slice both ways."""
        for i in range(0, len(self.first), BLOCK):
            for j in range(i if self.own else 0, len(self.second), BLOCK):
                a, b = self.first[i : i + BLOCK], self.second[j : j + BLOCK]
                yield a, b, _squared(self.x[a].astype(float), self.x[b].astype(float)) <= self.eps * self.eps

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        return self.own and a[0] == b[0]


def dbscan_table(df: DataFrame, key: str, vector: str, eps: float, min_samples: int, directions: int = DIRECTIONS, block: int | None = None) -> DataFrame:
    """V16, V29 over all rows: ``key, cluster``, the smallest key of the cluster's core rows; null for noise.

    A row is core if ``min_samples`` rows, itself included, are within ``eps``. Core rows within ``eps`` are one cluster; other rows
    join the cluster of the core row within ``eps`` that has the smallest key. Neighbours are counted by pairs of blocks and
    summed; a task passes on a spanning forest of its core links and not all of them, so edges grow with the rows.
    Blocks grow with the table up to ``LARGEST`` rows, so a row is shuffled at most about ``PARTS`` times (three cells of a direction
    aside) and not once for each further block; tasks compare them slice by slice. The products are quadratic in a cell.
    Rows with a null key, or a vector that is null, empty or not finite, are left out; repeated keys are rows of their
    own; an empty table gives no rows. All vectors have one length.
    """
    points = _points(df, key, vector)
    if points.isEmpty():
        return points.select(F.col("key").alias(key), F.col("key").alias("cluster"))
    block = block or min(LARGEST, max(BLOCK, -(-points.count() // PARTS)))
    met = _tiled(points, eps, _directions(points, directions), block)

    def count(table: pa.Table) -> pa.Table:
        pair = _Pair(table, eps)
        n = np.zeros(len(pair.ids), dtype=np.int64)
        for a, b, near in pair.tiles():
            n[a] += near.sum(axis=1)
            if not pair.alike(a, b):
                n[b] += near.sum(axis=0)
        return pa.table({"id": pair.ids, "n": n})

    counts = met().groupBy("task").applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = materialize(counts.where(F.col("n") >= min_samples).join(points.select("id", "key"), "id").select("id", F.col("key").alias("core_key")), "core")
    # a core row's place among all core rows by key stands for the key
    placed = materialize(numbered(core, ["core_key", "id"], "place"), "core-places")

    def link(table: pa.Table) -> pa.Table:
        pair = _Pair(table, eps)
        place = table.column("place").to_pandas().fillna(-1).to_numpy().astype(np.int64)
        is_core, none = place >= 0, np.iinfo(np.int64).max
        group, best = np.arange(len(place)), np.full(len(place), none)
        src, dst = [], []
        for a, b, near in pair.tiles():
            both = near & is_core[a][:, None] & is_core[b][None, :]
            both &= group[a][:, None] != group[b][None, :]
            if both.any():
                found = list(_forest(both, False))
                roots: dict[int, int] = {}

                def root(k: int, roots=roots) -> int:
                    while (up := roots.get(k, k)) != k:
                        k = up
                    return k

                for i, j in found:
                    p, q = root(int(group[a[i]])), root(int(group[b[j]]))
                    if p != q:
                        roots[max(p, q)] = min(p, q)
                        src.append(int(pair.ids[a[i]]))
                        dst.append(int(pair.ids[b[j]]))
                to = np.arange(len(place))
                for k in roots:
                    to[k] = root(k)
                group = to[group]
            for rows, others, t in ((a, b, near), *(() if pair.alike(a, b) else ((b, a, near.T),))):
                order = others[is_core[others]]
                edge = rows[~is_core[rows]]
                if len(order) and len(edge):
                    by = np.argsort(place[order])
                    hit = t[~is_core[rows]][:, is_core[others]][:, by]
                    at = hit.argmax(axis=1)
                    best[edge] = np.minimum(best[edge], np.where(hit[np.arange(len(edge)), at], place[order][by][at], none))
        on = np.flatnonzero(best < none)
        return pa.table({"id": np.concatenate([np.array(src, dtype=np.int64), pair.ids[on]]), "other": np.concatenate([np.array(dst, dtype=np.int64), best[on]]), "core": np.arange(len(src) + len(on)) < len(src)})

    marked = met(placed.select("id", "place"))
    links = materialize(marked.groupBy("task").applyInArrow(link, "id long, other long, core boolean"), "links")
    near = connected_components(links.where("core"), "id", "other").withColumnRenamed("node", "id")
    named = core.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("core_key").alias("cluster"))
    clusters = materialize(named.join(least, "component").select("id", "cluster"), "clusters")
    border = links.where("not core").groupBy("id").agg(F.min("other").alias("place")).join(placed.select("place", F.col("id").alias("other")), "place").select("id", "other")
    held = clusters.unionByName(border.join(clusters.withColumnRenamed("id", "other"), "other").select("id", "cluster"))
    return points.join(held, "id", "left").select(F.col("key").alias(key), "cluster")


def _forest(near: np.ndarray, own: bool) -> Iterator[tuple[int, int]]:
    """Links of ``near`` that span its components: rows and columns are two sides, or one and the same."""
    n, m = near.shape
    left, right = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
    for start in np.flatnonzero(near.any(axis=1)):
        if left[start]:
            continue
        left[start] = True
        todo = [(0, int(start))]
        while todo:
            side, k = todo.pop()
            fresh = np.flatnonzero((near[k] & ~right) if side == 0 else (near[:, k] & ~left))
            (right if side == 0 else left)[fresh] = True
            for f in fresh.tolist():
                i, j = (k, f) if side == 0 else (f, k)
                if not (own and i == j):
                    yield i, j
            todo += [(1 - side, f) for f in fresh.tolist()]


# --- clustering features ----------------------------------------------------------------------------


class Features:
    """Counts, sums and squared sums of groups of rows whose radius stays below a threshold; the threshold grows when there are too many."""

    def __init__(self, most: int, threshold: float = 0.0):
        self.most, self.threshold = most, threshold
        self.n, self.s, self.q = np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """Take in groups (single rows: 1, the row, its squared length), some at a time."""
        for at in range(0, len(n), 256):
            self._add(n[at : at + 256], s[at : at + 256], q[at : at + 256])
            while len(self.n) > self.most:
                self._grow()

    def _add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        if not len(self.n):
            self.s = np.zeros((0, s.shape[1]))
        fits = np.zeros(len(n), dtype=bool)
        if len(self.n):
            near = _squared(s / n[:, None], self.s / self.n[:, None]).argmin(axis=1)
            m, t, u = self.n[near] + n, self.s[near] + s, self.q[near] + q
            fits = u / m - (t * t).sum(axis=1) / (m * m) <= self.threshold**2 + 1e-12
            np.add.at(self.n, near[fits], n[fits])
            np.add.at(self.s, near[fits], s[fits])
            np.add.at(self.q, near[fits], q[fits])
        self.n, self.s, self.q = np.concatenate([self.n, n[~fits]]), np.concatenate([self.s, s[~fits]]), np.concatenate([self.q, q[~fits]])

    def _grow(self) -> None:
        c = self.s / self.n[:, None]
        d = _squared(c[:500], c)
        d[np.arange(len(d)), np.arange(len(d))] = np.inf
        self.threshold = max(1.2 * self.threshold, 0.5 * float(np.sqrt(np.median(d.min(axis=1)))), 1e-9)
        n, s, q = self.n, self.s, self.q
        self.n, self.s, self.q = np.zeros(0), np.zeros((0, s.shape[1])), np.zeros(0)
        order = np.argsort(-n, kind="stable")
        for at in range(0, len(n), 64):
            k = order[at : at + 64]
            self._add(n[k], s[k], q[k])

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "n": self.n, "s": list(self.s), "q": self.q})


_FEATURE = "part long, n double, s array<double>, q double"


def clustering_features(points: DataFrame, leaves: int = SAMPLE, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, centres)`` of at most ``leaves`` clustering features that stand for all rows of ``points`` (``v``).

    Each partition condenses its rows, then ``fan`` parts at a time are condensed together until one is left: a tree of
    merges, none of which holds more than ``fan`` times ``leaves`` features.
    """

    def condense(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = Features(leaves)
        for pdf in parts:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=float)
                own.add(np.ones(len(x)), x, (x * x).sum(axis=1))
        if len(own.n):
            yield own.frame(TaskContext.get().partitionId())

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Features(leaves)
        pdf = pdf.sort_values(["part", "n", "q"], ascending=[True, False, True])
        own.add(pdf["n"].to_numpy(), np.array(pdf["s"].tolist(), dtype=float), pdf["q"].to_numpy())
        return own.frame(int(pdf["part"].iloc[0]) // fan)

    t = materialize(points.select("v").mapInPandas(condense, _FEATURE), "features")
    parts = (t.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        t = materialize(t.groupBy((F.col("part") / fan).cast("long")).applyInPandas(join, _FEATURE), "features")
        parts = -(-parts // fan)
    rows = t.collect()  # at most ``leaves``
    n = np.array([r["n"] for r in rows])
    return n, np.array([r["s"] for r in rows], dtype=float) / n[:, None]


def hierarchy_table(df: DataFrame, key: str, vector: str, k: int | Callable[[int], int], linkage: str = "ward", leaves: int = SAMPLE) -> DataFrame:
    """V14, V16, V28 over all rows: ``key, cluster`` (from 0) of k groups of a hierarchy over clustering features.

    The hierarchy is built on at most ``leaves`` features with their sizes; every row takes the group of its nearest feature.
    Where there are no more different rows than leaves, it is the hierarchy of the rows. Rows with a null key, or a vector
    that is null, empty or not finite, are left out; repeated keys are rows of their own; an empty table gives no rows.
    """
    points = _points(df, key, vector)
    if points.isEmpty():
        return points.select(F.col("key").alias(key), F.lit(0).alias("cluster"))
    sizes, centres = clustering_features(points, leaves)
    label = cut(merges(centres, linkage, sizes), len(centres), min(len(centres), k if isinstance(k, int) else k(len(centres))))
    shared = df.sparkSession.sparkContext.broadcast((centres, label.astype(np.int32)))  # at most ``leaves`` rows
    kind = points.schema["key"].dataType.simpleString()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, own = shared.value
        for pdf in parts:
            if len(pdf):
                yield pd.DataFrame({key: pdf["key"], "cluster": own[_squared(np.array(pdf["v"].tolist(), dtype=float), c).argmin(axis=1)]})

    return points.select("key", "v").mapInPandas(place, f"{key} {kind}, cluster int")
