"""Operator 5: token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers, in ascending order:

    block*            entries: varint shared, varint unshared, varint value length, key suffix, value
    block index       for each block: first key, offset, size, entries, crc32 of the block
    Bloom filter      bit array over the keys, double hashing with xxhash64
    footer (64 bytes) index offset/size, Bloom offset/size, hash count, documents, ids, magic

Keys are 9 bytes that sort as the identifiers do (a null identifier sorts first). Values are the
document's ids as unsigned 16-bit (or 32-bit, for larger vocabularies), zstd-compressed. A lookup asks
the Bloom filter, searches the sparse index by bisection and scans one block.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import batches, doc_columns, shuffle_width, texts, tidy, tune
from litsieve.llm.files import atomic_write, open_random
from litsieve.llm.tokens import encoder, tokenizer_path
from litsieve.storage import fresh_dir

BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES, END_ID = 64 << 10, 10, 7, 0
#: A writer holds a key and ten unpacked filter bits for each document of its shard, about 80 bytes.
SHARD_DOCUMENTS = 1_000_000
#: Segments that an encoding worker remembers, about 160 MB; little else is held beside them.
CACHED = 800_000
_FOOTER, _MAGIC = struct.Struct("<QQQQIIQQ8s"), b"TOKSST01"
_BLOCK = struct.Struct("<9sQIII")


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Streams entries in ascending key order; holds one block, the index and the keys' hashes."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self.stream, self.block_bytes = stream, block_bytes
        self.block, self.last, self.first, self.entries = bytearray(), b"", b"", 0
        self.at, self.index, self.keys, self.ids = 0, [], [], 0

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if not self.entries:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(len(key)) if key[i] != self.last[i]), len(key))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.keys.append(key)
        self.ids += n_ids
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.index.append(_BLOCK.pack(self.first, self.at, len(self.block), self.entries, zlib.crc32(self.block)))
            self.stream.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    def finish(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=bool)
        for k in self.keys:
            bloom[_probes(k, bits, BLOOM_HASHES)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.stream.write(index)
        self.stream.write(packed)
        self.stream.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), BLOOM_HASHES, len(self.index), len(self.keys), self.ids, _MAGIC))


class ShardReader:
    """Scan or binary-search lookup of one shard."""

    def __init__(self, uri: str):
        self.file = open_random(uri)
        size = self.file.size()
        self.file.seek(size - _FOOTER.size)
        at, n, bloom_at, bloom_n, self.hashes, blocks, self.documents, self.ids, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(at)
        self.index = list(_BLOCK.iter_unpack(self.file.read(n)))
        self.firsts = [x[0] for x in self.index]
        self._bloom_at, self._bloom_n, self._bloom = bloom_at, bloom_n, None

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, entries, crc = self.index[k]
        self.file.seek(at)
        raw = self.file.read(n)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        key, p = b"", 0
        for _ in range(entries):
            shared, p = _read_varint(raw, p)
            own, p = _read_varint(raw, p)
            size, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + own]
            p += own
            yield key, raw[p : p + size]
            p += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield id_of(key), decode(value)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self.file.seek(self._bloom_at)
            self._bloom = np.unpackbits(np.frombuffer(self.file.read(self._bloom_n), dtype=np.uint8), bitorder="little")
        return bool(self._bloom[_probes(key_of(doc_id), len(self._bloom), self.hashes)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier (repeated rows give several)."""
        if not self.index or not self.may_hold(doc_id):
            return []
        want, found = key_of(doc_id), []
        k = max(bisect_right(self.firsts, want) - 1, 0)
        while k and self.firsts[k] == want:
            k -= 1
        while k < len(self.index) and self.firsts[k] <= want:
            found += [decode(v) for key, v in self._block(k) if key == want]
            k += 1
        return found


_ZIP: list = []


def encode_value(ids: bytes) -> bytes:
    """u32 ids to the stored form: their low halves alone, if the high ones are zero."""
    if not _ZIP:
        _ZIP.append(zstandard.ZstdCompressor(level=1))
    halves = np.frombuffer(ids, dtype="<u2")
    if halves[1::2].any():
        return b"\x04" + _ZIP[0].compress(ids)
    return b"\x02" + _ZIP[0].compress(halves[::2].tobytes())


def decode(value: bytes) -> np.ndarray:
    raw = zstandard.decompress(value[1:])
    return np.frombuffer(raw, dtype="<u2" if value[0] == 2 else "<u4").astype("<u4")


def write_shards(docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> list[tuple]:
    """Encode every text and write the shards below ``uri``; returns ``(shard, uri, documents, ids)`` in id order.

    Documents are dealt by quantiles of doc_id (from that column alone), sorted inside each task, and
    streamed to one file for each task; there are as many shards as the shuffle is wide, more where one would hold over
    ``SHARD_DOCUMENTS``. A null text is an empty one, a null doc_id sorts first, repeated doc_ids are kept side by side, an
    empty table gives no shards. An id (or null) with so many rows that it is several quantiles at once is dealt over all
    shards between them (quantiles are doubles, so not ids beyond 2^53). Other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    path = path or tokenizer_path()
    counted = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    n = shards or max(shuffle_width(spark), -(-counted.n // SHARD_DOCUMENTS))
    unnamed = n * (counted.n - counted.named) // max(1, counted.n)
    end = np.array([end_id], dtype="<u4").tobytes()
    named = n - unnamed
    cuts = texts(docs).approxQuantile("doc_id", [i / named for i in range(1, named)], 0.2 / named) if named > 1 else []
    cuts = sorted(int(c) for c in cuts)
    mid = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("value", pa.binary())])
    made = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def encode(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, limit=CACHED)

        dealt: dict[tuple, int] = {}

        def shard_of(doc_id: int | None, ids: bytes) -> int:
            lo, hi = (0, max(0, unnamed - 1)) if doc_id is None else (unnamed + bisect_left(cuts, doc_id), unnamed + bisect_right(cuts, doc_id))
            if hi - lo < (1 if doc_id is None else 2):
                return lo if doc_id is None else hi
            # equal rows go round the shards, so the outcome does not depend on the order in which a task meets rows
            what = (doc_id, zlib.crc32(ids))
            seen = dealt[what] = dealt.get(what, -1) + 1
            return lo + (what[1] + seen) % (hi - lo + 1)

        def rows():
            for doc_ids, some in doc_columns(parts):
                for doc_id, ids in zip(doc_ids, enc.encode_column(some), strict=True):
                    ids += end
                    yield doc_id, shard_of(doc_id, ids), len(ids) // 4, encode_value(ids)

        yield from batches(rows(), mid)

    def store(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (b for b in parts if b.num_rows)
        first = next(held, None)
        if first is None:
            return
        shard = first.column(1)[0].as_py()
        name = f"{uri}/shard-{shard:06d}.sst"
        with atomic_write(name) as stream:
            writer = ShardWriter(stream)
            for b in itertools.chain([first], held):
                _feed(writer, b)
            writer.finish()
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((shard, name, len(writer.keys), writer.ids), made, strict=True)], schema=made)

    ids = texts(docs).mapInArrow(tidy(encode), "doc_id long, shard int, n_ids long, value binary")
    dealt = ids.repartitionById(unnamed + len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_ids", "value")
    return [tuple(r) for r in sorted(dealt.mapInArrow(tidy(store), "shard int, uri string, documents long, ids long").collect())]


def _feed(writer: ShardWriter, b: pa.RecordBatch) -> None:
    for doc_id, n, value in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
        writer.add(key_of(doc_id), value, n)


def read_shards(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read back from the files."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    base, jobs = 0, []
    for shard, uri, _, ids in manifest:
        jobs.append((shard, uri, base))
        base += ids

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for uri, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    for doc_id, ids in ShardReader(uri).scan():
                        yield doc_id, at, len(ids), zlib.crc32(ids.tobytes())
                        at += len(ids)

        yield from batches(rows(), schema)

    table = spark.createDataFrame(jobs, "shard int, uri string, base long").repartitionById(max(1, len(jobs)), F.col("shard"))
    return table.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: list[tuple], wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` for the wanted identifiers: only the blocks that may hold them are read.

    The shards' first keys (one a shard) say which shards to open. A null identifier finds documents without one, a repeated
    one is asked once and gives a row for each document that has it, an unknown one gives none; no shards or nothing
    wanted give an empty table. Columns of ``wanted`` other than doc_id are not read.
    """
    rank = lambda i: (i is not None, i or 0)  # noqa: E731  # null sorts first
    edges = [rank(id_of(ShardReader(m[1]).firsts[0])) for m in manifest[1:]]
    uris = [m[1] for m in manifest]
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def search(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, ShardReader] = {}

        def rows():
            for b in parts:
                for doc_id in b.column(0).to_pylist():
                    for k in range(bisect_left(edges, rank(doc_id)), bisect_right(edges, rank(doc_id)) + 1):  # equal ids may fill several shards
                        if k not in open_:
                            open_[k] = ShardReader(uris[k])
                        for ids in open_[k].get(doc_id):
                            yield doc_id, ids.astype(np.int64).tolist()

        yield from batches(rows(), schema)

    if not manifest:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return wanted.select(F.col("doc_id").cast("long")).distinct().mapInArrow(tidy(search), "doc_id long, ids array<long>")


def op5_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, fresh_dir(spark, "sst")))
