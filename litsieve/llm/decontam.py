"""Operator 3: benchmark decontamination by a hash set of normalised test n-grams.

Words are runs of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered. Every 10
consecutive words of a benchmark item are a window; an item with fewer words, but not none, is one
window. Workers slide over documents: hashes of windows are rolled from word hashes over all positions at once, looked up in
a bit table and a sorted hash array, and every hit is verified against the item's own words.

The window set is broadcast while the size of its arrays, by a count of the items' words, allows. Beyond that it is written to the shared
folder in chunks of that size and every worker passes over the chunks one after another for each batch
of documents, so memory stays bounded and the result is the same.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import BROADCAST_BYTES, batches, texts, tidy, tune
from litsieve.llm.files import atomic_write, open_random
from litsieve.llm.jaccard import word_hashes
from litsieve.storage import fresh_dir

WINDOW = 10
#: Bytes that part words become spaces, A-Z their lower case.
_NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: What a window's hash, item, place and bits take, and the text whose words are hashed at once.
WORD_BYTES, GROUP_BYTES = 24, 256 << 10


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Windows:
    """Windows of some items, in flat arrays of about 30 bytes a word.

    ``blob`` holds the items' words, one space apart. For each window length there are the sorted hashes of the windows, the
    item and the place in ``blob`` of each, and a bit table of the hashes that lets most places of a document pass at once.
    """

    def __init__(self, items: Iterable[tuple[str, str]], size: int = WINDOW):
        self.names: list[str] = []
        kept, found, at = [], {}, 0
        for name, text in items:
            own = words(text)
            n = min(size, len(own))
            if not n:
                continue
            raw = b" ".join(own)
            ends = np.cumsum([len(w) + 1 for w in own], dtype=np.int64) - 1
            starts = ends - np.array([len(w) for w in own])
            found.setdefault(n, []).append((_sums(word_hashes(raw), n), np.full(len(own) - n + 1, len(self.names), dtype=np.int32), (at + starts[: len(own) - n + 1]).astype(np.uint32), (at + ends[n - 1 :]).astype(np.uint32)))
            self.names.append(name)
            kept.append(raw)
            at += len(raw) + 1
        self.blob = b" ".join(kept)
        self.lengths: dict[int, tuple[np.ndarray, ...]] = {}
        for n, parts in sorted(found.items()):
            sums, item, start, stop = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((item, sums))
            self.lengths[n] = (sums[order], item[order], start[order], stop[order], _bits(sums))
        found.clear()

    def nbytes(self) -> int:
        return len(self.blob) + sum(a.nbytes for arrays in self.lengths.values() for a in arrays)

    def hits(self, h: np.ndarray, bounds: np.ndarray, own: list[bytes]) -> Iterator[tuple[int, int, int, set[str]]]:
        """``(document, first word, length, items)`` of every window; h: word hashes of documents, which begin at ``bounds``."""
        split: dict[int, list[bytes]] = {}
        for n, (sums, item, start, stop, bits) in self.lengths.items():
            if len(h) < n:
                continue
            there = _sums(h, n)
            p = np.flatnonzero(_among(bits, there))
            lo = np.searchsorted(sums, there[p])
            lo[lo == len(sums)] = 0
            p, lo = (x[sums[lo] == there[p]] for x in (p, lo))
            doc = np.searchsorted(bounds, p, "right") - 1
            inside = p + n <= bounds[doc + 1]
            for at, first, d in zip(p[inside].tolist(), lo[inside].tolist(), doc[inside].tolist(), strict=True):
                if d not in split:
                    split[d] = own[d].split()
                k = at - int(bounds[d])
                said = b" ".join(split[d][k : k + n])
                last = int(np.searchsorted(sums, sums[first], "right"))
                same = {self.names[item[x]] for x in range(first, last) if self.blob[start[x] : stop[x]] == said}
                if same:
                    yield d, k, n, same


def _bits(sums: np.ndarray) -> np.ndarray:
    size = 1 << max(10, int(len(sums) * 16 - 1).bit_length())
    out = np.zeros(size >> 3, dtype=np.uint8)
    at = sums & np.uint64(size - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return out


def _among(bits: np.ndarray, sums: np.ndarray) -> np.ndarray:
    at = sums & np.uint64((len(bits) << 3) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial sum modulo 2**64 of each n consecutive hashes."""
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + h[k : k + len(out)]
    return out


def _joined(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of normal texts, one text after the other, and where each begins, with the end."""
    raw = b" ".join(own)
    h = word_hashes(raw)
    b = np.frombuffer(raw, dtype=np.uint8) != 32
    starts = np.flatnonzero(b & np.concatenate([[True], ~b[:-1]])) if len(b) else np.zeros(0, dtype=np.int64)
    begin = np.cumsum([0, *(len(r) + 1 for r in own)])
    return h, np.searchsorted(starts, begin)


def judge(own: list[bytes], sets: Iterable[Windows]) -> list[tuple[np.ndarray, set[str]]]:
    """Of each normal text: which words lie inside a window, and the items whose windows occur."""
    h, bounds = _joined(own)
    out = [(np.zeros(int(n), dtype=bool), set()) for n in np.diff(bounds)]
    for w in sets:
        for d, p, n, found in w.hits(h, bounds, own):
            out[d][0][p : p + n] = True
            out[d][1].update(found)
    return out


class WindowSets:
    """The windows of a benchmark, in chunks whose built arrays take about ``chunk_bytes``.

    One chunk travels with the tasks. More are files in the shared folder that each worker reads in turn.
    """

    def __init__(self, benchmark: DataFrame, size: int = WINDOW, chunk_bytes: int = BROADCAST_BYTES):
        spark = benchmark.sparkSession
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string")).where("item_id is not null and text is not null")
        n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + WORD_BYTES * n_words + 64), F.lit(0))).first()[0]
        n = 1 + total // chunk_bytes
        self.inline, self.uris = None, []
        if n == 1:
            self.inline = Windows(items.collect(), size)  # at most chunk_bytes, built
            return
        root = fresh_dir(spark, "windows")

        def store(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in parts for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                with atomic_write(uri := f"{root}/{uuid.uuid4().hex}") as f:
                    f.write(pickle.dumps(Windows(rows, size)))
                yield pa.RecordBatch.from_pydict({"uri": [uri]})

        self.uris = [r[0] for r in items.repartition(int(n)).mapInArrow(tidy(store), "uri string").collect()]

    def each(self) -> Iterator[Windows]:
        if self.inline is not None:
            yield self.inline
        for uri in self.uris:
            with open_random(uri) as f:
                yield pickle.loads(f.read())


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chunk_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row.

    A null text has no words; items with a null id or text are no items, an empty benchmark hits
    nothing; rows with a null or repeated doc_id are each judged; repeated items count once by id; an empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    sets = WindowSets(benchmark, size, chunk_bytes)
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for doc_id, hit, items in _judged(b.column(0), b.column(1), sets):
                    n = int(hit.sum())
                    yield doc_id, len(hit), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0

        yield from batches(rows(), schema)

    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _judged(ids: pa.Array, column: pa.Array, sets: WindowSets) -> Iterator[tuple[int | None, np.ndarray, set[str]]]:
    """Documents in groups of about ``GROUP_BYTES``, against one chunk of windows after the other."""
    at, n = 0, len(ids)
    while at < n:
        own, size, end = [], 0, at
        while end < n and (not own or size < GROUP_BYTES):
            own.append((column[end].as_py() or "").encode("utf-8", "surrogatepass").translate(_NORMAL))
            size += len(own[-1])
            end += 1
        for doc_id, (hit, items) in zip(ids.slice(at, end - at).to_pylist(), judge(own, sets.each()), strict=True):
            yield doc_id, hit, items
        at = end


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW, chunk_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without benchmark passages, in the columns they came with.

    ``mode="documents"`` drops every document with a hit. ``mode="spans"`` keeps them and cuts the hit
    words with what stands between them, until no window is left; ``n_chars`` follows, if it is there. Null and blank texts
    have no hit and stay as they are, with or without a doc_id; rows that repeat an id are each judged; an empty table or an
    empty benchmark changes nothing; other columns pass through, whatever their names.
    """
    sets = WindowSets(benchmark, size, chunk_bytes)
    tune(docs.sparkSession)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            hit = [h.any() for _, h, _ in _judged(b.column(at), b.column(at), sets)]
            if mode == "documents":
                yield b.filter(pa.array([not h for h in hit]))
                continue
            old = b.column(at).to_pylist()
            new = [cut_spans(t, sets) if h else t for t, h in zip(old, hit, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, type=b.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([len(x) if h else n for n, x, h in zip(b.column(count).to_pylist(), new, hit, strict=True)], type=b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def cut_spans(text: str, sets: WindowSets) -> str:
    while True:
        raw = text.encode("utf-8", "surrogatepass")
        normal = raw.translate(_NORMAL)
        own = normal.split()
        ((hit, _),) = judge([normal], sets.each())
        if not hit.any():
            return text
        keep, at, last = [], 0, 0
        k = 0
        places = []
        for w in own:
            at = normal.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        while k < len(own):
            if not hit[k]:
                k += 1
                continue
            start = places[k][0]
            while k < len(own) and hit[k]:
                k += 1
            keep.append(raw[last:start])
            last = places[k - 1][1]
        text = b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
