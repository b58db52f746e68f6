"""Operator 13: alignment of two tokenizers over the bytes of the same texts.

The texts of a whole Arrow batch are one run of bytes with the documents' offsets. Token lengths of
both tokenizers are summed to ends, the ends are counted once by place, and

* where both have an end, the tokens are cut into groups;
* between two neighbouring ends of either lies one overlap of one token of each, so every place with an
  end is one link; prefix counts of the ends name its two tokens;
* prefix sums at the documents' offsets give each document's groups, links and sums.

Links are counted corpus-wide as a table of id pairs, summed by Spark. What fits a stated number of
pairs is read by the workers from the shared folder; links of the remaining, rarer pairs go through a join,
so that the result is exact for any number of pairs.

Neither tokenizer joins across a single space between two visible characters, so a batch's distinct
words are encoded once each; a text that cannot be cut so is encoded whole.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import ON_RELEASE, texts, tidy, tune
from litsieve.llm.files import locate
from litsieve.llm.tokens import _CHARS, TOKENIZER, encoder, tokenizer_path
from litsieve.storage import materialize

PIECES = "piece_bpe_32k.model"
#: Pairs of ids that a worker holds at most (17 bytes each), pairs that it gathers before it sends them on, bytes of text handled at once.
PAIRS_HELD, PAIRS_GATHERED, BATCH_TEXT = 3_000_000, 2_000_000, 2 << 20
_COMMON, _LIMIT = 150_000, 400_000
_SPACE = "▁"
#: No ids, and no ids because the text is not given back.
_NONE, _BAD = (b"", b""), (b"", b"", None)
_LOADED: dict[tuple[str, str], PairCoder] = {}
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PairCoder:
    """Ids of both tokenizers for texts, each with one space before it, and the bytes of every id.

    The piece model must put a space before the text, keep texts as they are and have no piece without bytes.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoder(a_path, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        raw = {c: bytes([b]) for b, c in enumerate(_CHARS)}
        entries = self.a.tok.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = b"".join(raw[c] for c in entry) if all(c in raw for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Whether no piece holds a space behind another character, nor a line end: only then may texts be cut there.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        self.prefix = self.b.piece_to_id(_SPACE)
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def forget(self) -> None:
        self.cache = dict(islice(self.cache.items(), _COMMON))

    def _checked(self, a: bytes, ids: list[int], text: bytes) -> tuple[bytes, bytes] | None:
        """Both encodings, or none where the joined bytes of one are not the text's."""
        own = np.frombuffer(a, dtype="<u4").tolist()
        if b"".join(map(self.a_bytes.__getitem__, own)) != text or b"".join(map(self.b_bytes.__getitem__, ids)) != text:
            return None
        return a, np.array(ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Words after one space, or after the line end they start with; their bytes are checked together."""
        a, b = self.a._words(words), self.b.encode(words)
        lines = [k for k, w in enumerate(words) if w[0] == "\n"]
        for k in lines:
            if b[k][:1] == [self.prefix]:
                del b[k][0]
        flat = np.fromiter(chain.from_iterable(b), dtype="<u4")
        sizes = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        want = [" " + w for w in words]
        for k in lines:
            want[k] = words[k]
        whole = "".join(want).encode()
        length = pc.binary_length(pa.array(want)).to_numpy()
        own = np.frombuffer(b"".join(a), dtype="<u4")
        of_a = np.fromiter(map(len, a), dtype=np.int64, count=len(a)) // 4
        ends = np.cumsum(sizes)
        fits = lambda n, ids, each: bool(n.all()) and np.array_equal(np.add.reduceat(each[ids], np.cumsum(n) - n), length)
        if fits(of_a, own, self.a_len) and fits(sizes, flat, self.b_len) and b"".join(map(self.a_bytes.__getitem__, own.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, flat.tolist())) == whole:
            raw = flat.tobytes()
            return [(x, raw[lo:hi]) for x, lo, hi in zip(a, ((ends - sizes) * 4).tolist(), (ends * 4).tolist(), strict=True)]
        return [self._checked(x, y, t.encode()) for x, y, t in zip(a, b, want, strict=True)]

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        spaced = [" " + t for t in texts]
        return [self._checked(a, b, t.encode()) for t, a, b in zip(spaced, self.a._library(spaced), self.b.encode(texts), strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and document bounds of both tokenizers; texts that are empty or not given back byte by byte have no ids."""
        gc.disable()  # nothing here is cyclic, and the cache is long to walk
        try:
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = pc.dictionary_encode(lists.flatten())
            words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            known, odd, bad = self._lookup(words)
            each = lambda flag: np.logical_or.reduceat(flag[at], starts[:-1])
            careful, no = each(odd), each(bad)
            pairs = [*known, _NONE]
            out = np.repeat(careful | no, np.diff(starts))
            at[out] = len(words)
            whole = np.flatnonzero(careful)
            given = self._whole([column[k].as_py() for k in whole.tolist()])
            for k, p in zip(whole.tolist(), given, strict=True):
                if p is not None and len(column[k].as_py()):
                    at[starts[k]] = len(pairs)
                    pairs.append(p)
            return (*_gathered([p[0] for p in pairs], at, starts), *_gathered([p[1] for p in pairs], at, starts))
        finally:
            gc.enable()

    def _lookup(self, words: list[str]) -> tuple[list[tuple[bytes, bytes]], np.ndarray, np.ndarray]:
        """Both encodings of each word, which words need their text whole, and which ones are not given back."""
        out = list(map(self.cache.get, words))
        odd = np.zeros(len(words), dtype=bool)
        missing = []
        for k in [k for k, p in enumerate(out) if p is None]:
            inner = words[k][1:] if words[k][:1] == "\n" else words[k]
            if not self.cuts or not inner or inner[0].isspace() or inner[-1].isspace():
                odd[k], out[k] = True, _NONE
            else:
                missing.append(k)
        if len(self.cache) + len(missing) > _LIMIT:
            self.forget()
        if missing:
            for k, p in zip(missing, self._words([words[k] for k in missing]), strict=True):
                out[k] = p = p or _BAD
                if len(words[k]) <= 64:
                    self.cache[words[k]] = p
        return out, odd, np.fromiter((p is _BAD for p in out), dtype=bool, count=len(out))


def _gathered(ids: list[bytes], at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after the other, and the bounds of the documents among them."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    pool = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    each = sizes[at]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin[at] - ends + each, each) + np.arange(total)], np.concatenate([[0], ends])[starts]


@dataclass
class Alignment:
    """Ends of both tokenizers over the bytes of several documents."""

    a_ids: np.ndarray
    a_at: np.ndarray
    b_ids: np.ndarray
    b_at: np.ndarray
    a_len: np.ndarray
    b_len: np.ndarray

    def __post_init__(self):
        self.a_end, self.b_end = np.cumsum(self.a_len[self.a_ids]), np.cumsum(self.b_len[self.b_ids])
        size = (int(self.a_end[-1]) if len(self.a_end) else 0) + 1
        in_a, in_b = (np.bincount(x, minlength=size) for x in (self.a_end, self.b_end))
        self.both = in_a & in_b
        self.groups = np.cumsum(self.both)
        self.bytes_at = np.concatenate([[0], self.a_end])[self.a_at]
        ends = in_a | in_b
        place = np.flatnonzero(ends)
        self.link_at = np.cumsum(ends)[self.bytes_at]
        self.link_a = self.a_ids[(np.cumsum(in_a) - in_a)[place]]
        self.link_b = self.b_ids[(np.cumsum(in_b) - in_b)[place]]

    def n_groups(self) -> np.ndarray:
        return np.diff(self.groups[self.bytes_at])

    def listings(self, table: np.ndarray) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document; ``table`` has the digits of each id before ``,``, ``|`` and ``;``."""
        last_a, last_b = self.both[self.a_end], self.both[self.b_end]
        own_a, own_b = self.groups[self.a_end] - last_a, self.groups[self.b_end] - last_b
        n = int(self.groups[-1])
        many_a, many_b = np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n)
        line = np.empty(len(self.a_ids) + len(self.b_ids), dtype=table.dtype)
        line[np.arange(len(own_a)) + (np.cumsum(many_b) - many_b)[own_a]] = table[last_a, self.a_ids]
        line[np.arange(len(own_b)) + np.cumsum(many_a)[own_b]] = table[2 * last_b, self.b_ids]
        at = (self.a_at + self.b_at).tolist()
        for lo, hi in zip(at, at[1:], strict=False):
            yield line[lo:hi].tobytes().translate(None, b"\0")[:-1]


def digits(n: int) -> np.ndarray:
    return np.array([[f"{k}{mark}".encode() for k in range(n)] for mark in ",|;"])


def coder(a_path: str, b_path: str) -> PairCoder:
    """One for each Python worker."""
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = own = PairCoder(a_path, b_path)
        ON_RELEASE.append(own.forget)
    return _LOADED[key]


def _aligned(parts: Iterable[pa.RecordBatch], both: PairCoder) -> Iterator[tuple[pa.Array, Alignment]]:
    """Ids and alignment of whole documents, about ``BATCH_TEXT`` bytes at a time."""
    for b in parts:
        column = pc.fill_null(b.column(1), "")
        size = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_TEXT, side="right")))
            yield b.column(0).slice(at, upto - at), Alignment(*both.encode(column.slice(at, upto - at)), both.a_len, both.b_len)
            at = upto


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``pair, n, best``: each linked pair of ids (A's times the size of B's vocabulary, plus B's), its links corpus-wide,
    and whether no other pair of its B id has more."""
    tune(docs.sparkSession)
    a_path, b_path = a_path or tokenizer_path(TOKENIZER), b_path or tokenizer_path(PIECES)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def sent(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], schema=schema)

        for _, x in _aligned(parts, both):
            held.append(np.unique(x.link_a * len(both.b_len) + x.link_b, return_counts=True))
            if sum(len(k) for k, _ in held) > PAIRS_GATHERED:
                held = [merged()]
                if len(held[0][0]) > PAIRS_GATHERED // 2:
                    yield from sent(*held.pop())
        if held:
            yield from sent(*merged())

    counted = materialize(texts(docs).mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    size = _vocabulary(b_path)
    top = counted.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("top"))
    # one row for each id of a vocabulary: bounded whatever the corpus
    return counted.join(F.broadcast(top), (F.col("pair") % size) == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


class HeldPairs:
    """The pairs of a Parquet folder, sorted; a worker keeps those it read last for its next task."""

    _last: tuple[str, HeldPairs] | None = None

    def __init__(self, uri: str):
        import pyarrow.parquet as pq

        fs, path = locate(uri)
        t = pq.read_table(path, filesystem=fs)
        pair = t["pair"].to_numpy()
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], t["n"].to_numpy()[order], t["best"].to_numpy()[order]

    @classmethod
    def of(cls, uri: str) -> HeldPairs:
        if cls._last is None or cls._last[0] != uri:
            cls._last = (uri, cls(uri))
        return cls._last[1]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and flags of the pairs (0 where a pair is not held), and which ones are held."""
        if not len(self.pair):
            return np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool), np.zeros(len(pairs), dtype=bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        held = self.pair[at] == pairs
        return self.n[at] * held, self.best[at] & held, held


def _split(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs that workers hold, at most ``limit``, and the rarer rest: cut at a power of two of the count."""
    level = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True)  # at most 63 rows
    total = cut = 0
    for k, n in sizes:
        if total + n > limit:
            cut = k + 1
            break
        total += n
    if not cut:
        return counts, None
    return materialize(counts.where(level >= cut), "pairs-held"), counts.where(level < cut)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pairs_held: int = PAIRS_HELD) -> DataFrame:
    """One row for each document: tokens of both, groups, links, how many links are their B id's most frequent, the sum of
    their corpus-wide counts, and the digest of the groups.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and ''. Rows with a
    null or repeated doc_id are documents of their own, an empty table gives no rows, other columns are not looked at.
    """
    a_path, b_path = a_path or tokenizer_path(TOKENIZER), b_path or tokenizer_path(PIECES)
    counts = materialize(pair_counts(docs, a_path, b_path), "pair-counts")
    held, rest = _split(counts, pairs_held)
    uri = held.table_path
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (c.split()[0] for c in ALIGNED.split(", "))] + [("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, found = coder(a_path, b_path), HeldPairs.of(uri)
        table = digits(max(len(both.a_len), len(both.b_len)))
        for ids, x in _aligned(parts, both):
            pairs = x.link_a * len(both.b_len) + x.link_b
            n, best, known = found.find(pairs)
            summed = lambda v, x=x: np.diff(np.concatenate([[0], np.cumsum(v)])[x.link_at])
            a, b = np.diff(x.a_at), np.diff(x.b_at)
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in x.listings(table)]
            rare, times = _rare(pairs, known, x.link_at)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (a, b, x.n_groups(), np.diff(x.link_at), summed(best), summed(n))), pa.array(digest, type=pa.string()), pa.array(rare, type=schema.field("rare").type), pa.array(times, type=schema.field("times").type)],
                schema=schema,
            )

    out = texts(docs).mapInArrow(tidy(run), ALIGNED + ", rare array<long>, times array<long>")
    columns = [c.split()[0] for c in ALIGNED.split(", ")]
    if rest is None:
        return out.select(*columns)
    rows = materialize(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
    spread = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = spread.join(rest, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    add = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return rows.join(more, "row", "left").select(*[add(c, "more_best") if c == "n_best" else add(c, "more_sum") if c == "count_sum" else c for c in columns])


def _rare(pairs: np.ndarray, known: np.ndarray, link_at: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Each document's pairs that are not held, with how often it links them."""
    n = len(link_at) - 1
    if known.all():
        return [[]] * n, [[]] * n
    out, times = [], []
    for lo, hi in zip(link_at.tolist(), link_at[1:].tolist(), strict=False):
        keys, many = np.unique(pairs[lo:hi][~known[lo:hi]], return_counts=True)
        out.append(keys.tolist())
        times.append(many.tolist())
    return out, times


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
