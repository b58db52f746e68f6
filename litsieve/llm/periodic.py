"""Operator 12: maximal periodic runs of words, by the Lyndon roots of the runs theorem.

A run is a stretch of words with smallest period q, at least twice as long as q, that neither
neighbouring word extends. The root of a run is the longest Lyndon word that begins at some place of
it, under the order of the words or under the reversed one. So:

1. texts of an Arrow batch are one array of word numbers, with a mark smaller than all words between
   documents; it is scanned once from right to left under each order. A stack holds the places whose
   longest Lyndon word is not closed yet, and suffixes are compared by their longest common extension;
2. that extension is read word by word at first, then found by binary search over rolling hashes and
   held against the words themselves, so that a collision cannot change it. What is known to repeat at a
   distance is remembered for each distance, which keeps long runs linear;
3. each root is extended to both sides by binary searches over the same hashes, for all roots of the
   batch at once. Distinct results are verified word by word, and what a collision made too long is
   extended anew by the words.

No suffix array is built. A document is read whole in one task, documents are dealt out by Spark's splits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import ON_RELEASE, batches, doc_rows, texts, tidy, tune

LEAST, REPEATS = 12, 2
#: Words that are scanned together; a longer document is scanned alone.
BATCH_WORDS = 400_000
#: Words compared one by one before hashes are asked.
_DIRECT = 8
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Numbers(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Hashes:
    """Prefix sums of ``value * base**place``, from which any two stretches are compared; ``w`` starts and ends with a mark."""

    _powers = np.ones(1, dtype=np.int64)

    def __init__(self, w: np.ndarray):
        self.w = w
        power = Hashes._power(len(w))
        self.sums = np.zeros(len(w) + 1, dtype=np.int64)
        np.cumsum((w * 2_654_435_761 + 97) % _PRIME * power[: len(w)] % _PRIME, out=self.sums[1:])
        self.sums %= _PRIME

    @classmethod
    def _power(cls, n: int) -> np.ndarray:
        while len(cls._powers) < n:
            cls._powers = np.concatenate([cls._powers, cls._powers * pow(_BASE, len(cls._powers), _PRIME) % _PRIME])
        return cls._powers

    @classmethod
    def forget(cls) -> None:
        cls._powers = cls._powers[: 1 << 20].copy()

    def same(self, i, j, n):
        """Whether n words from i and from j > i have one hash (places may be arrays)."""
        s = self.sums
        return ((s[i + n] - s[i]) % _PRIME) * self._powers[j - i] % _PRIME == (s[j + n] - s[j]) % _PRIME

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest stretches of one hash that begin at i and j."""
        lo, hi = np.zeros_like(most), most.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.same(i, j, mid)
            lo, hi = np.where(open_ & ok, mid, lo), np.where(open_ & ~ok, mid - 1, hi)
        return lo

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest stretches of one hash that end before i and j."""
        lo, hi = np.zeros_like(most), most.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.same(i - mid, j - mid, mid)
            lo, hi = np.where(open_ & ok, mid, lo), np.where(open_ & ~ok, mid - 1, hi)
        return lo


ON_RELEASE.append(Hashes.forget)


class Scan:
    """Ends of the longest Lyndon words of an array of documents with marks (-1) between."""

    def __init__(self, w: np.ndarray, hashes: Hashes, ends_of: np.ndarray):
        self.w, self.h, self.last = w, hashes, ends_of
        self.known: dict[int, tuple[int, int]] = {}

    def extension(self, i: int, j: int) -> int:
        """How many words agree from i and j on; the first ``_DIRECT`` are known to."""
        d, a = j - i, i + _DIRECT
        region = self.known.get(d)
        if region is not None and i <= region[1] and a >= region[0]:
            self.known[d] = (i, region[1])
            return region[1] - i
        most = int(self.last[i]) - j
        if region is not None and region[0] > a and region[0] - i <= most and self.h.same(i, j, region[0] - i):
            top, joined = region[0] - i, region[1] - i
        else:
            lo, hi = _DIRECT, most
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if self.h.same(i, j, mid):
                    lo = mid
                else:
                    hi = mid - 1
            top = joined = lo
        off = self.w[a : i + top] != self.w[a + d : j + top]
        if off.any():  # a collision: the words decide
            joined = _DIRECT + int(off.argmax())
        self.known[d] = (i, i + joined)
        return joined

    def lyndon_ends(self, order: np.ndarray) -> np.ndarray:
        """For each place the end of its longest Lyndon word under the order of the given numbers (marks: -1)."""
        w = order.tolist()
        ends = [0] * len(w)
        stack: list[int] = []
        push, pop = stack.append, stack.pop
        direct, extension = _DIRECT, self.extension
        for i in range(len(w) - 1, -1, -1):
            c = w[i]
            if c < 0:  # a mark ends the document to its left
                stack.clear()
                self.known.clear()
                push(i)
                continue
            t = stack[-1]
            while True:
                d = w[t]
                if c > d:
                    break
                if c == d:
                    a, b, top = i + 1, t + 1, i + direct
                    while a < top and w[a] == w[b]:
                        a += 1
                        b += 1
                    if a == top:
                        n = extension(i, t)
                        a, b = i + n, t + n
                    if w[a] > w[b]:
                        break
                pop()
                t = stack[-1]
            ends[i] = t
            push(i)
        return np.array(ends, dtype=np.int64)


def runs_of(docs: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """All runs ``(start, length, period)`` of each document (word numbers from 0), by start, then period."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    mark = np.array([-1], dtype=np.int64)
    w = np.concatenate([mark, *(x for d in docs for x in (d, mark))])
    begin = np.cumsum(sizes + 1) - sizes  # place of each document's first word
    doc = np.repeat(np.arange(len(docs)), sizes)
    i = np.arange(len(doc)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    last = np.zeros(len(w), dtype=np.int64)
    last[i] = (begin + sizes)[doc]
    h = Hashes(w)
    scan = Scan(w, h, last)
    found = []
    top = int(w.max(initial=0))
    for order in (w, np.where(w < 0, w, top - w)):
        found.append(_extended(h, i, scan.lyndon_ends(order)[i], begin[doc], last[i], least))
    spans, _ = _distinct(np.concatenate(found))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    owner = np.searchsorted(begin, spans[:, 0], side="right") - 1
    for k, (a, b, p) in zip(owner.tolist(), spans.tolist(), strict=True):
        out[k].append((a - int(begin[k]), b - a, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _extended(h: Hashes, i: np.ndarray, j: np.ndarray, begin: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Rows (first place, end, period) of the roots i..j that extend to runs of ``least`` words or more."""
    w = h.w
    need = max(1, (least // 2 + 1) // 2)  # the longer side of what a root lacks, whatever its length
    right, left = np.ones(len(i), dtype=bool), np.ones(len(i), dtype=bool)
    for k in range(need):  # the marks beside a document differ from its words, so no side leaves it
        for side, a, b in ((right, i + k, j + k), (left, i - 1 - k, j - 1 - k)):
            on = np.flatnonzero(side)
            side[on] = (w[np.clip(a[on], 0, len(w) - 1)] == w[np.clip(b[on], 0, len(w) - 1)]) & (w[np.clip(a[on], 0, len(w) - 1)] >= 0)
    keep = right | left
    i, j, begin, last = i[keep], j[keep], begin[keep], last[keep]
    period = j - i
    ends = j + h.right(i, j, last - j)
    starts = i - h.left(i, j, i - begin)
    n = ends - starts
    ok = n >= np.maximum(least, REPEATS * period)
    rows = np.stack([starts[ok], ends[ok], period[ok]], axis=1)
    whole, back = _distinct(rows)
    good = [np.array_equal(w[a : b - p], w[a + p : b]) for a, b, p in whole.tolist()]
    if all(good):
        return whole
    again = [(*_by_words(w, x, y, lo, hi), y - x) for x, y, lo, hi, k in zip(i[ok].tolist(), j[ok].tolist(), begin[ok].tolist(), last[ok].tolist(), back.tolist(), strict=True) if not good[k]]
    held = [r for r in again if r[1] - r[0] >= max(least, REPEATS * r[2])]
    return np.concatenate([whole[np.array(good)], np.array(held, dtype=np.int64).reshape(-1, 3)])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    own = rows[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (own[1:] != own[:-1]).any(axis=1)
    back = np.empty(len(rows), dtype=np.int64)
    back[order] = np.cumsum(first) - 1
    return own[first], back


def _by_words(w: np.ndarray, i: int, j: int, begin: int, last: int) -> tuple[int, int]:
    """The same extension from the words alone."""
    off = np.flatnonzero(w[i : last - (j - i)] != w[j:last])
    end = j + (int(off[0]) if len(off) else last - j)
    off = np.flatnonzero(w[begin:i] != w[begin + j - i : j])
    return (begin + int(off[-1]) + 1 if len(off) else begin), end


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, q in runs:
        step[start + q] += 1
        step[start + n] -= 1
    return [x for x, inside in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not inside]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own periodic tails: a tenth of the documents, by the id's crc32, repeat p words from word a on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


@dataclass
class _Report:
    doc_id: int | None
    words: list[bytes]

    def row(self, runs: list[tuple[int, int, int]]) -> tuple:
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        own = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        return (self.doc_id, len(runs), *own, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(self.words, runs))).hexdigest())


def _grouped(rows: Iterable[tuple[int | None, list[bytes]]], most: int) -> Iterator[list[_Report]]:
    held, total = [], 0
    for doc_id, words in rows:
        if held and total + len(words) > most:
            yield held
            held, total = [], 0
        held.append(_Report(doc_id, words))
        total += len(words)
    if held:
        yield held


def detect(docs: DataFrame, least: int = LEAST, edit=None) -> DataFrame:
    """One row for each document: its number of runs, the longest run, and digests of all runs and of the collapsed text.

    Words are stretches without ASCII white space; ``edit(doc_id, words)`` may change them before the
    scan. The longest run is null where there is none (ties: smallest start, then period). A null text has no
    words; rows with a null or repeated doc_id are documents of their own; an empty table gives no rows.
    Columns other than doc_id and text are not looked at.
    """
    tune(docs.sparkSession)
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in (c.split()[0] for c in RUNS.split(", "))])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            cut = ((i, t.encode("utf-8", "surrogatepass").split()) for i, t in doc_rows(parts))
            for group in _grouped(((i, edit(i, ws) if edit else ws) for i, ws in cut), BATCH_WORDS):
                number = Numbers().__getitem__
                coded = [np.fromiter(map(number, r.words), dtype=np.int64, count=len(r.words)) for r in group]
                for r, runs in zip(group, runs_of(coded, least), strict=True):
                    yield r.row(runs)

        yield from batches(rows(), schema)

    return texts(docs).mapInArrow(tidy(run), RUNS)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with every text's runs cut down to their first period, words joined by one space.

    Texts without a run stay as they are, null texts too; all columns and rows are kept.
    """
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            new: list[str | None] = []
            held = b.column(at).to_pylist()
            for group in _grouped(((k, (t or "").encode().split()) for k, t in enumerate(held)), BATCH_WORDS):
                number = Numbers().__getitem__
                coded = [np.fromiter(map(number, r.words), dtype=np.int64, count=len(r.words)) for r in group]
                for r, runs in zip(group, runs_of(coded, least), strict=True):
                    new.append(b" ".join(collapsed(r.words, runs)).decode() if runs else held[r.doc_id])
            columns = list(b.columns)
            columns[at] = pa.array(new, type=b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), docs.schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=planted)
