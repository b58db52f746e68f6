"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one Arrow batch to a Python worker holds at most.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"
#: Largest side that is ever broadcast, by a count of its rows times their width.
BROADCAST_BYTES = 32 << 20


def tune(spark: SparkSession) -> None:
    """Keep a Python worker's batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """The id and the text alone, so that no other column is read or shipped."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def semi_join_checked(rows: DataFrame, ids: DataFrame, key: str, n_ids: int, width: int = 32) -> DataFrame:
    """Rows whose key is among ``ids``: broadcast while the counted size allows, else a shuffle join."""
    side = F.broadcast(ids) if n_ids * width <= BROADCAST_BYTES else ids.hint("shuffle_hash")
    return rows.join(side, key, "left_semi")


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4000, byte_cap: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples, cut by number and by the bytes of binary or string values."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or total >= byte_cap:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def doc_rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    """``(doc_id, text)`` with null text as empty, a few at a time."""
    for b in parts:
        ids = b.column(0)
        col = b.column(1)
        for at in range(0, b.num_rows, 128):
            for i, t in zip(ids.slice(at, 128).to_pylist(), col.slice(at, 128).to_pylist(), strict=True):
                yield i, t or ""


def doc_groups(parts: Iterable[pa.RecordBatch], size: int = 128) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of up to ``size`` documents, null text as empty."""
    for b in parts:
        for at in range(0, b.num_rows, size):
            yield b.column(0).slice(at, size).to_pylist(), [t or "" for t in b.column(1).slice(at, size).to_pylist()]


def doc_columns(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and the texts of each batch as a column, null text as empty."""
    for b in parts:
        if b.num_rows:
            yield b.column(0).to_pylist(), pc.fill_null(b.column(1), "")


#: What else a worker can drop between tasks.
ON_RELEASE: list[Callable[[], None]] = []


def release() -> None:
    """Give a Python worker's free memory back to the system: it outlives its task and waits beside the next stage's."""
    for drop in ON_RELEASE:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A partition function that leaves no memory behind."""

    def wrapped(parts):
        try:
            yield from run(parts)
        finally:
            release()

    return wrapped
