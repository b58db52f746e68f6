"""Operator 1: best-fit packing of documents into sequences by linear grouping.

The method (de la Vega and Lueker's scheme with Gilmore and Gomory's column generation):

1. lengths above ``large_above`` are sorted and cut into ``groups`` groups of equal cardinality,
   and every length is rounded up to the largest of its group;
2. the few rounded sizes are packed by a configuration linear program; configurations are rounded
   down, what is left over is placed by best fit on the rounded sizes;
3. the actual documents take the places of the rounded ones;
4. small lengths fill the space left by best fit, longest first.

The solver sees only the histogram of lengths (at most ``seq_len`` rows, whatever the corpus), and
its plan is a list of patterns with multiplicities, also of bounded size. Documents find their
place by length and rank, in parallel: ranks come from counts for (length, hash bucket), so a length
that a third of all pieces share is dealt over many tasks.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import batches, doc_columns, shuffle_width, texts, tidy, tune
from litsieve.llm.tokens import encoder, tokenizer_path
from litsieve.storage import materialize

SEQ_LEN, END_ID = 1024, 2
LARGE_ABOVE, GROUPS = 256, 100
#: Sequences of large documents that keep more space than this are opened again for best fit.
SLACK = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens: whole ones, the first may be shorter."""
    first = (n - 1) % seq_len + 1 if n else 0
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


def pieces(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids as binary (u32, little-endian).

    A null or empty text is one piece that holds the end id alone. A null doc_id is kept.
    """
    tune(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)

        def rows():
            for doc_ids, some in doc_columns(parts):
                for doc_id, ids in zip(doc_ids, enc.encode_column(some), strict=True):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, seq_len)):
                        own = ids[4 * s : 4 * (s + n)]
                        yield (doc_id, k, s, n, zlib.crc32(own)) + ((own,) if with_ids else ())

        yield from batches(rows(), schema)

    return texts(docs).mapInArrow(tidy(run), PIECES + ", ids binary" * with_ids)


@dataclass
class Bins:
    """``count`` sequences of one make: ``slots`` of (length, how many in each)."""

    slots: list[tuple[int, int]]
    count: int
    free: int = field(default=0)


def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of (length, count), longest first, in groups of equal cardinality with the size each is rounded up to."""
    total = sum(hist.values())
    if not total:
        return []
    each = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            take = min(left, room)
            out[-1][1].append((length, take))
            left -= take
            room -= take
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, runs in out:
        merged.setdefault(size, []).extend(runs)
    return sorted(merged.items(), reverse=True)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[list[tuple[int, int]], float]]:
    """Configurations and their (fractional) use, by column generation with a revised simplex."""
    k = len(sizes)
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = [[(i, capacity // sizes[i])] for i in range(k)]
    inverse = np.diag([1.0 / (capacity // x) for x in sizes])
    x = inverse @ d
    for _ in range(rounds):
        dual = inverse.sum(axis=0)  # every configuration costs one sequence
        config, value = _knapsack(s, np.maximum(dual, 0), capacity)
        if value <= 1 + 1e-6:
            break
        column = np.zeros(k)
        for i, n in config:
            column[i] = n
        move = inverse @ column
        ratio = np.full(k, np.inf)
        np.divide(x, move, out=ratio, where=move > 1e-9)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        pivot = inverse[leave] / move[leave]
        inverse -= np.outer(move, pivot)
        inverse[leave] = pivot
        x = np.maximum(x - move * ratio[leave], 0)
        x[leave] = ratio[leave] if np.isfinite(ratio[leave]) else 0
        basis[leave] = config
    return list(zip(basis, x.tolist(), strict=True))


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[list[tuple[int, int]], float]:
    """Most valuable multiset of sizes within the capacity (sizes fall)."""
    rising, worth = sizes[::-1], value[::-1]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(rising, np.arange(capacity + 1), side="right")
    for c in range(int(rising[0]), capacity + 1):
        n = fits[c]
        got = best[c - rising[:n]] + worth[:n]
        i = int(np.argmax(got))
        if got[i] > best[c - 1]:
            best[c], pick[c] = got[i], i
        else:
            best[c] = best[c - 1]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        i = len(sizes) - 1 - int(pick[c])
        found[i] = found.get(i, 0) + 1
        c -= int(rising[pick[c]])
    return sorted(found.items()), float(best[capacity])


class _BestFit:
    """Bins by the space left; equal bins are moved together."""

    def __init__(self, capacity: int, bins: list[Bins]):
        self.capacity, self.by_free, self.frees = capacity, {}, []
        for b in bins:
            self._add(b)

    def _add(self, b: Bins) -> None:
        if not b.count:
            return
        if b.free not in self.by_free:
            insort(self.frees, b.free)
        self.by_free.setdefault(b.free, []).append(b)

    def _take(self, length: int) -> Bins | None:
        at = bisect_left(self.frees, length)
        if at == len(self.frees):
            return None
        free = self.frees[at]
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free]
            self.frees.pop(at)
        return b

    def place(self, length: int, count: int) -> None:
        """Put each of ``count`` pieces where the least space is left; a bin takes them until it is full, as one by one."""
        while count:
            b = self._take(length) or Bins([], -(-count // (self.capacity // length)), self.capacity)
            per = b.free // length
            if count < per:
                per, use = count, 1
            else:
                use = min(b.count, count // per)
            self._add(Bins(list(b.slots), b.count - use, b.free))
            self._add(Bins([*b.slots, (length, per)], use, b.free - per * length))
            count -= use * per
        # bins opened for a count that is no multiple are returned empty: dropped in done()

    def done(self) -> list[Bins]:
        return [b for f in self.frees for b in self.by_free[f] if b.slots]


def plan(hist: dict[int, int], seq_len: int = SEQ_LEN, large_above: int = LARGE_ABOVE, groups: int = GROUPS, slack: int = SLACK) -> list[Bins]:
    """Patterns with multiplicities that hold exactly the lengths of the histogram."""
    hist = {k: v for k, v in hist.items() if k > 0 and v > 0}
    bins = [Bins([(seq_len, 1)], hist[seq_len], 0)] if seq_len in hist else []
    large = {k: v for k, v in hist.items() if large_above < k < seq_len}
    grouped = linear_groups(large, groups)
    if grouped:
        sizes = [g[0] for g in grouped]
        runs = [list(reversed(g[1])) for g in grouped]  # popped from the end: longest first
        left = [sum(n for _, n in r) for r in runs]
        use: list[tuple[list[tuple[int, int]], int]] = []
        for config, x in configurations(sizes, left, seq_len):
            n = min([int(x + 1e-7), *(left[i] // c for i, c in config)])
            if n > 0:
                use.append((config, n))
                for i, c in config:
                    left[i] -= n * c
        rest: dict[int, int] = {}
        for config, n in use:
            for b in _substitute(config, n, runs, seq_len):
                if b.free <= slack:
                    bins.append(b)
                    continue
                for length, per in b.slots:
                    rest[length] = rest.get(length, 0) + per * b.count
        # what rounding down left over
        for r in runs:
            for length, n in r:
                rest[length] = rest.get(length, 0) + n
    else:
        rest = {}
    fit = _BestFit(seq_len, bins)
    for length in sorted(rest, reverse=True):
        fit.place(length, rest[length])
    for length in sorted((k for k in hist if k <= large_above and k != seq_len), reverse=True):
        fit.place(length, hist[length])
    return fit.done()


def _substitute(config: list[tuple[int, int]], count: int, runs: list[list[tuple[int, int]]], seq_len: int) -> list[Bins]:
    """Actual lengths in the places of rounded ones, in as few makes as the runs allow."""
    out = []
    while count:
        step = min([count, *(runs[i][-1][1] // c for i, c in config)])
        slots: list[tuple[int, int]] = []
        many = max(step, 1)
        for i, c in config:
            need = c
            while need:
                length, have = runs[i].pop()
                take = c if step else min(need, have)
                if have > take * many:
                    runs[i].append((length, have - take * many))
                slots.append((length, take))
                need -= take
        out.append(Bins(slots, many, seq_len - sum(a * b for a, b in slots)))
        count -= many
    return out


def layout(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks and where they go, sorted by (length, first rank)."""
    rows, seen, sequence = [], {}, 0
    for b in bins:
        at = 0
        for length, per in b.slots:
            rank = seen.get(length, 0)
            rows.append((length, rank, per, sequence, at))
            seen[length] = rank + per * b.count
            at += per * length
        sequence += b.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "per", "sequence", "at"), table.T.copy(), strict=True))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rank``: 0.. among the rows of each length, counted over hash buckets and not in one task.

    Bucket counts are summed in two levels, so that no window sees more than about the square root of the buckets.
    """
    buckets = 4 * shuffle_width(rows.sparkSession)
    width = math.isqrt(buckets - 1) + 1
    b = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = b.groupBy("length", "bucket").count().withColumn("group", F.floor(F.col("bucket") / width).cast("int"))
    so_far = lambda by, order: F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("length", "group").agg(F.sum("count").alias("count")).select("length", "group", so_far(["length"], "group").alias("before"))
    base = counts.select("length", "bucket", "group", so_far(["length", "group"], "bucket").alias("base")).join(groups, ["length", "group"])
    inside = Window.partitionBy("length", "bucket").orderBy(*keys)
    return (
        b.withColumn("rank", F.row_number().over(inside) - 1)
        .join(base.select("length", "bucket", (F.col("base") + F.col("before")).alias("base")), ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("base", "bucket")
    )


def pack(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, large_above: int = LARGE_ABOVE, groups: int = GROUPS) -> DataFrame:
    """Every piece with its sequence and its offset there: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Sequences hold at most ``seq_len`` ids and no gaps. Nulls: a null text is an empty one; rows with a
    null or repeated doc_id are documents of their own. An empty table gives no rows. Columns other
    than doc_id and text are not looked at.
    """
    cut_up = materialize(pieces(docs, path, seq_len, end_id), "pieces")
    hist = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}  # at most seq_len rows
    where = layout(plan(hist, seq_len, large_above, groups))
    step = int(max(where["rank"], default=0)) + 1
    key = where["length"] * step + where["rank"]
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])

    def place(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            i = np.searchsorted(key, length * step + np.minimum(rank, step - 1), side="right") - 1
            inside = rank - where["rank"][i]
            own = [b.column(b.schema.get_field_index(f.name)) for f in list(schema)[:5]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(where["sequence"][i] + inside // where["per"][i]), pa.array(where["at"][i] + inside % where["per"][i] * length)], schema=schema)

    return ranked(cut_up, ["doc_id", "piece", "ids_crc32"]).mapInArrow(tidy(place), PIECES + ", sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
