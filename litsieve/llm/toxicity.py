"""Operator 8: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled text (U) train a numpy classifier with the estimator of
Kiryo et al. ("Positive-Unlabeled Learning with Non-Negative Risk Estimator"): the risk is
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``; where the second part falls below zero, its
gradient is stepped against. The class prior is the share of toxic rows among the labelled training
rows. Only rows with ``crc32(doc_id as text) mod 5 <> 0`` are ever learnt from.

The classifier pools over a document's distinct words. A word's pieces start at each of its letters; a piece
has a logit, linear in hashed features (the piece, its first letters, its character 4- and 5-grams), the highest
is the word's, and the document's logit is a smooth maximum of its words'. So one toxic word marks a text of any
length, unseen inflections and compounds of known stems count, and a stem in a long run (script without spaces, glued
words) counts as it does in a short word. Fit and score pool alike. Labels, language, source and doc_id are no inputs of a score.

The fit sees a bounded sample of the labelled training rows: at most ``MAX_POSITIVE`` toxic ones as P and ``MAX_UNLABELLED`` of
all of them, whatever their label, as U, those with the smallest hash of their id. Scoring covers every row and the whole of
its text.

Steps, rate and decay are chosen by ``choose`` on an inner split of the training rows (remainder 1 judges what remainders 2 to 4
teach); the held-out rows (remainder 0) have no part in it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import batches, doc_groups, texts, tidy, tune

MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
#: The fit's settings, as ``choose`` found them.
STEPS, RATE, DECAY = 40, 0.1, 1e-4
BITS, FOLDS = 18, 5
DIMENSIONS = 1 << BITS
_WORD = re.compile(r"[^\W\d_]+")


#: Letters of a piece; pieces start at every letter that three more follow.
PIECE = 12


def words(text: str) -> set[str]:
    """The distinct runs of letters."""
    return set(_WORD.findall(text.lower()))


#: Pieces whose features are made at once.
_CHUNK = 20_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_OPEN, _CLOSE = np.uint64(ord("<")), np.uint64(ord(">"))


def pieces(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces of the words, some at a time: whose word's each is, its characters in a row, and how many there are.

    A piece is ``<`` and up to ``PIECE`` letters, as if it began the word, and ``>`` where the word ends with it. Pieces start at
    every letter that three more follow, and at the first.
    """
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    many = np.maximum(1, size - 3)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), many)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    for at in range(0, len(owner), _CHUNK):
        own, i = owner[at : at + _CHUNK], inner[at : at + _CHUNK]
        left = size[own] - i
        n = np.minimum(left, PIECE)
        place = np.arange(PIECE)
        body = flat[np.minimum((first[own] + i)[:, None] + place, len(flat) - 1)].astype(np.uint64)
        row = np.zeros((len(own), PIECE + 2), dtype=np.uint64)
        row[:, 0] = _OPEN
        row[:, 1 : PIECE + 1] = np.where(place < n[:, None], body, 0)
        ends = np.flatnonzero(left <= PIECE)
        row[ends, n[ends] + 1] = _CLOSE
        yield own, row, n + 1 + (left <= PIECE)


def features(row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of pieces and which of them there are: character 4- and 5-grams, the first six, the whole."""
    wide = row.shape[1]
    four = ((row[:, :-3] * _MIX[0] + row[:, 1:-2]) * _MIX[0] + row[:, 2:-1]) * _MIX[0] + row[:, 3:]
    five = four[:, :-1] * _MIX[1] + row[:, 4:]
    whole = row[:, 0].copy()
    for k in range(1, wide):
        whole = whole * _MIX[2] + row[:, k]
    six = five[:, 0] * _MIX[3] + row[:, 5]
    grams = np.concatenate([four, five, six[:, None], (whole ^ _MIX[1])[:, None]], axis=1)
    there = np.concatenate([np.arange(wide - 3) + 4 <= n[:, None], np.arange(wide - 4) + 5 <= n[:, None], (n > 6)[:, None], np.ones((len(n), 1), dtype=bool)], axis=1)
    grams ^= grams >> np.uint64(29)
    return ((grams * _MIX[2]) >> np.uint64(64 - BITS)).astype(np.int32), there


class Model:
    """A word's logit is the highest sum of ``theta`` over a piece's features, less ``OFFSET``; documents pool them."""

    def __init__(self, theta: np.ndarray, bias: float):
        self.theta, self.bias = theta, bias
        self._known: dict[str, float] = {}

    def weights(self, own: set[str]) -> dict[str, float]:
        """``exp`` of the words' logits, those of short words from what was computed before."""
        known = self._known
        new = [w for w in own if w not in known]
        if len(known) + len(new) > 300_000:
            known.clear()
            new = list(own)
        if not new:
            return known
        top = np.full(len(new), -np.inf)
        for owner, row, n in pieces(new):
            ids, there = features(row, n)
            np.maximum.at(top, owner, np.where(there, self.theta[ids], 0).sum(axis=1, dtype=np.float64))
        e = np.exp(np.minimum(top - OFFSET, 30.0)).tolist()
        known.update((w, v) for w, v in zip(new, e, strict=True) if len(w) <= 64)
        long = {w: v for w, v in zip(new, e, strict=True) if len(w) > 64}
        return known | long if long else known

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[float]:
        return self.of_words([words(t) for t in texts])

    def of_words(self, own: list[set[str]]) -> list[float]:
        """Scores of documents, given as sets of words."""
        weigh = self.weights(set().union(*own)).__getitem__
        z = self.bias + np.log(np.array([sum(map(weigh, o)) for o in own]) + FLOOR)
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).tolist()

    def __getstate__(self):
        return {"theta": self.theta, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(state["theta"], state["bias"])


#: A word's logit starts this far below zero; the pool of an empty text is the floor.
OFFSET, FLOOR = 8.0, float(np.exp(-6.0))


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of document logits, and the step's direction for each.

    With the logistic loss ``l(+) = log(1 + e^-z)``, ``l(-) = log(1 + e^z)``. Where ``E_U[l(-)] - prior * E_P[l(-)]`` is below
    zero the direction is the gradient of its negative, alone; else that of the risk.
    """
    up = 1 / (1 + np.exp(-np.clip(z, -60, 60)))  # the derivative of l(-)
    neg = np.logaddexp(0, z)
    n_p, n_u = is_p.sum(), (~is_p).sum()
    first = prior * np.logaddexp(0, -z[is_p]).mean()
    rest = neg[~is_p].mean() - prior * neg[is_p].mean()
    g = np.zeros(len(z))
    if rest >= 0:
        g[is_p] = prior * (up[is_p] - 1) / n_p - prior * up[is_p] / n_p
        g[~is_p] = up[~is_p] / n_u
    else:
        g[is_p] = prior * up[is_p] / n_p
        g[~is_p] = -up[~is_p] / n_u
    return float(first + max(0.0, rest)), g


class Bags:
    """Documents as bags of distinct words, words as pieces with hashed features, in flat arrays."""

    def __init__(self, documents: list[tuple[bool, str]]):
        vocab: dict[str, int] = {}
        held, sizes = array("i"), []  # flat, as lists would take ten times the memory
        for _, said in documents:
            own = said.split()
            sizes.append(len(own))
            held.extend(vocab.setdefault(w, len(vocab)) for w in own)
        every = list(vocab)
        del vocab
        owner, flat, f_sizes = array("i"), array("i"), array("i")  # these grow in place; pieces to join would be there twice
        for own, row, n in pieces(every):
            ids, there = features(row, n)
            owner.frombytes(own.astype(np.int32).tobytes())
            flat.frombytes(ids[there].tobytes())
            f_sizes.frombytes(there.sum(axis=1).astype(np.int32).tobytes())
        self.n, self.n_words = len(documents), len(every)
        self.flat, self.f_flat = np.frombuffer(held, dtype=np.int32), np.frombuffer(flat, dtype=np.int32)
        self.doc_of = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.f_sizes = np.frombuffer(f_sizes, dtype=np.int32).astype(np.int64)
        self.f_starts = np.cumsum(self.f_sizes) - self.f_sizes
        self.many = np.bincount(np.frombuffer(owner, dtype=np.int32), minlength=self.n_words)
        self.p_starts = np.cumsum(self.many) - self.many
        #: The piece that gave each word its logit last.
        self.best = self.p_starts

    def logits(self, theta: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document logits, their pools, and the words' weights."""
        each = np.empty(len(self.f_starts), dtype=theta.dtype)
        for i in range(0, len(each), 200_000):
            j = min(i + 200_000, len(each))
            lo = self.f_starts[i]
            each[i:j] = np.add.reduceat(theta[self.f_flat[lo : self.f_starts[j - 1] + self.f_sizes[j - 1]]], self.f_starts[i:j] - lo)
        top = np.maximum.reduceat(each, self.p_starts)
        at = np.flatnonzero(each == np.repeat(top, self.many))
        self.best = at[np.searchsorted(at, self.p_starts)]  # the first of equal ones
        e = np.exp(np.minimum(top - OFFSET, 30))
        pooled = np.bincount(self.doc_of, e[self.flat], self.n) + FLOOR
        return bias + np.log(pooled), pooled, e

    def gradient(self, g: np.ndarray, pooled: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The gradient by ``theta`` of what has gradient ``g`` by document logits (words at the cap of 30 count as below it)."""
        gw = np.bincount(self.flat, (g / pooled)[self.doc_of], self.n_words) * e
        grad = np.zeros(DIMENSIONS)
        for i in range(0, self.n_words, 50_000):  # what is as long as all features is made in slices
            best = self.best[i : i + 50_000]
            n = self.f_sizes[best]
            ends = np.cumsum(n)
            own = self.f_flat[np.repeat(self.f_starts[best] - ends + n, n) + np.arange(ends[-1])]
            grad += np.bincount(own, np.repeat(gw[i : i + 50_000], n), DIMENSIONS)
        return grad


def fit(documents: list[tuple[bool, str]], prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """nnPU by full-batch Adam; ``documents``: (is positive, distinct words joined by spaces)."""
    theta, bias = np.zeros(DIMENSIONS, dtype=np.float32), 0.0
    is_p = np.array([p for p, _ in documents], dtype=bool)
    if not is_p.any() or is_p.all() or not 0 < prior < 1:
        return Model(theta, -40.0 if not is_p.any() or prior <= 0 else 0.0)
    bags = Bags(documents)
    if not len(bags.flat):
        return Model(theta, 0.0)
    m, v = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    mb = vb = 0.0
    for t in range(1, steps + 1):
        z, pooled, e = bags.logits(theta, bias)
        _, g = risk(z, is_p, prior)
        grad = decay * theta.astype(np.float64) + bags.gradient(g, pooled, e)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        gb = g.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        theta -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return Model(theta, float(bias))


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, use: tuple[int, ...] = (1, 2, 3, 4)) -> tuple[DataFrame | None, float]:
    """The bounded training sample as sets of words (``p, words``; none without toxic rows), and the class prior; ``use``: remainders learnt from.

    Ids are chosen first, from the labels alone; the chosen ones (at most the two bounds) are broadcast and only their
    texts are read out, one for each id (of several texts the one whose words sort first).
    """
    if not set(use) <= set(range(1, FOLDS)):
        raise ValueError("held-out rows are not to be learnt from")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & remainder().isin(*use))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return None, 0.0
    few = lambda df, salt, k: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(k)
    marked = few(known.where("toxic = 1"), 1, max_positive).withColumn("p", F.lit(True)).union(few(known, 2, max_unlabelled).withColumn("p", F.lit(False)))
    ids = [(r[0], r[1]) for r in marked.collect()]  # at most max_positive + max_unlabelled
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, p boolean")
    schema = pa.schema([("doc_id", pa.int64()), ("p", pa.bool_()), ("words", pa.string())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for at in range(0, b.num_rows, 64):
                    for doc_id, text, p in zip(*(c.slice(at, 64).to_pylist() for c in b.columns), strict=True):
                        yield doc_id, p, " ".join(sorted(words(text or "")))

        yield from batches(rows(), schema)

    said = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "p").mapInArrow(tidy(run), "doc_id long, p boolean, words string")
    return said.groupBy("doc_id", "p").agg(F.min("words").alias("words")).select("p", "words"), toxic / n


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, use: tuple[int, ...] = (1, 2, 3, 4)) -> tuple[list[tuple[bool, str]], float]:
    """``training_sample`` on the driver, in order."""
    rows, prior = training_sample(docs, labels, max_positive, max_unlabelled, use)
    return sorted((r.p, r.words) for r in rows.collect()) if rows is not None else [], prior


def choose(docs: DataFrame, labels: DataFrame, grid: list[tuple[int, float, float]], max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> list[tuple[float, tuple[int, float, float]]]:
    """Balanced accuracy of each ``(steps, rate, decay)`` on the inner split, best first; ties to the earlier one.

    Models learn from remainders 2 to 4 and are judged on the labelled rows of remainder 1, at most the two bounds of them.
    """
    taught, prior = training_rows(docs, labels, max_positive, max_unlabelled, (2, 3, 4))
    judged, _ = training_rows(docs, labels, max_positive, max_unlabelled, (1,))
    toxic = [w for p, w in judged if p]
    clean = sorted({w for p, w in judged if not p} - set(toxic))
    out = []
    for setting in grid:
        model = fit(taught, prior, *setting)
        caught = np.mean([v >= 0.5 for w in toxic for v in model.of_words([set(w.split())])]) if toxic else 0.0
        left = np.mean([v < 0.5 for w in clean for v in model.of_words([set(w.split())])]) if clean else 0.0
        out.append((float(caught + left) / 2, setting))
    return sorted(out, key=lambda x: -x[0])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The fit on the bounded sample, in one task: the driver gets the weights, and neither the texts nor their features."""
    rows, prior = training_sample(docs, labels, max_positive, max_unlabelled)
    if rows is None:
        return fit([], prior)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = sorted(x for b in parts for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit(taught, prior)
        yield pa.RecordBatch.from_pydict({"theta": [model.theta.tobytes()], "bias": [model.bias]})

    got = rows.repartition(1).mapInArrow(tidy(run), "theta binary, bias double").first()
    return Model(np.frombuffer(got.theta, dtype=np.float32), got.bias) if got else fit([], prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null text scores as an empty one. A null doc_id is no held-out row. Rows with repeated ids are each
    scored. Without toxic labels every score is near 0; an empty table gives no rows. Columns other
    than doc_id and text are not read.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for ids, some in doc_groups(parts):
                for doc_id, s in zip(ids, model.scores(some), strict=True):
                    yield doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0, s, int(s >= 0.5)

        yield from batches(rows(), schema)

    return texts(docs).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, in the columns they came with.

    A null text scores as an empty one; rows with a null or repeated doc_id are each judged; an empty table gives no rows;
    other columns pass through, whatever their names.
    """
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(0, b.num_rows, 128):
                some = b.slice(k, 128)
                yield some.filter(pa.array([v < 0.5 for v in model.scores([t or "" for t in some.column(at).to_pylist()])], type=pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op8_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, train(docs, labels))
