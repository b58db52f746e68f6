"""Operator 9: exact top-k search by tiled matrix products.

Query vectors are written to the shared folder in tiles. Each task gathers its candidates in
shards of bounded size, reads one query tile after another, multiplies it with the shard tile by tile,
and selects each query's best within a tile by a partial sort. The short lists meet in a tree:
first over groups of shards, then over all of them, by a window whose limit Spark applies before
its shuffle. Vectors are never shuffled and no side is broadcast, whatever the number of queries.

Components become ``floor(scale * x)``, x as double, so scores are whole numbers. Products run in double
precision where no sum can reach 2**53, else on Python's integers (scores then saturate at 64 bits).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import batches, tidy, tune
from litsieve.llm.files import atomic_write, open_random
from litsieve.storage import fresh_dir

QUERY_ROWS, SHARD_BYTES, TILE_ROWS, FAN = 2048, 16 << 20, 2048, 8
_EXACT = float(1 << 53)


def quantised(b: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, ids, whole-number vectors)`` of the usable rows of a batch."""
    ids = b.column(0)
    for dim, rows in _by_length(b.column(1)).items():
        if not dim:
            continue
        own = b.column(1).take(pa.array(rows))
        flat = own.flatten()
        if flat.null_count:
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        else:
            x = flat.to_numpy().astype(np.float64)
        x = x.reshape(-1, dim)
        key = ids.take(pa.array(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * x)
        good = np.isfinite(x).all(axis=1) & ~np.array(key.is_null())
        if good.any():
            yield dim, np.array(key.filter(pa.array(good)).to_pylist(), dtype=np.int64), x[good]


def _by_length(column: pa.Array) -> dict[int, list[int]]:
    import pyarrow.compute as pc

    out: dict[int, list[int]] = {}
    for i, n in enumerate(pc.list_value_length(column).to_pylist()):
        if n is not None:
            out.setdefault(n, []).append(i)
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products as int64."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < _EXACT:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in c], dtype=object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the k highest scores, ties to smaller ids; ``ids`` rise. The row's own id takes no part."""
    n = scores.shape[1]
    out = []
    left = np.searchsorted(ids, own, side="left")
    right = np.searchsorted(ids, own, side="right")
    for r in range(scores.shape[0]):
        s, i = scores[r], ids
        if left[r] < right[r]:
            s, i = np.delete(s, slice(left[r], right[r])), np.delete(i, slice(left[r], right[r]))
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > edge)
            level = np.flatnonzero(s == edge)[: k - len(above)]
            pick = np.concatenate([above, level])
        else:
            pick = np.arange(len(s))
        pick = pick[np.lexsort((i[pick], -s[pick]))] if n else pick
        out.append((i[pick], s[pick]))
    return out


def _merge(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return b
    ids, s = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    pick = np.lexsort((ids, -s))[:k]
    return ids[pick], s[pick]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best among all vectors but its own id.

    Both tables have ``vec_id`` and ``embedding``. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; vectors of unequal length are not compared.
    Repeated ids are candidates each; of repeated query ids the smallest vector is searched. An empty side
    gives no rows. Extra columns are not read.
    """
    spark = vectors.sparkSession
    tune(spark)
    cols = (F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    root = fresh_dir(spark, "queries")

    def store(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            with atomic_write(uri := f"{root}/{uuid.uuid4().hex}") as f:
                f.write(pickle.dumps((ids, x)))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "uri": [uri]})

        for b in parts:
            for dim, ids, x in quantised(b, scale):
                held.setdefault(dim, []).append((ids, x))
                if sum(len(i) for i, _ in held[dim]) >= QUERY_ROWS:
                    yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    # an id's vectors that take no part must not stand in the way of one that does
    sound = queries.select(*cols).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    one = sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    tiles: dict[int, list[str]] = {}
    for dim, uri in sorted(tuple(r) for r in one.mapInArrow(tidy(store), "dim int, uri string").collect()):
        tiles.setdefault(dim, []).append(uri)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])

    def multiply(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(dim: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            mark = int(ids[0] & 0xFFFF) % 997
            for uri in tiles.get(dim, ()):
                with open_random(uri) as f:
                    own, q = pickle.loads(f.read())
                lists: list = [None] * len(own)
                for at in range(0, len(ids), TILE_ROWS):
                    got = best(products(q, x[at : at + TILE_ROWS]), ids[at : at + TILE_ROWS], own, k)
                    lists = [_merge(a, b, k) for a, b in zip(lists, got, strict=True)]
                sizes = [len(i) for i, _ in lists]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([i for i, _ in lists])), pa.array(np.concatenate([s for _, s in lists])), pa.array(np.full(sum(sizes), mark, dtype=np.int32))], schema=schema)

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in parts:
            for dim, ids, x in quantised(b, scale):
                held.setdefault(dim, []).append((ids, x))
                if sum(v.nbytes for _, v in held[dim]) >= SHARD_BYTES:
                    yield from shard(dim, held.pop(dim))
        for dim, own in held.items():
            yield from shard(dim, own)

    lists = vectors.select(*cols).mapInArrow(tidy(multiply), "query_id long, vec_id long, score long, shard int")
    order = (F.desc("score"), F.asc("vec_id"))
    first = Window.partitionBy("query_id", F.col("shard") % FAN).orderBy(*order)
    last = Window.partitionBy("query_id").orderBy(*order)
    halfway = lists.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    return halfway.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
