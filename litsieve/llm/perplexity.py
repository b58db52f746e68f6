"""Operator 2: quality by the perplexity of a modified Kneser-Ney model.

An interpolated modified Kneser-Ney model (Chen and Goodman) of byte n-grams is trained on trusted text. A 5-gram fits
a long exactly, its context is a shift and its shorter grams are masks, so every count table is a DataFrame keyed by
longs and the model is joins of counts, dealt by gram.

Trusted documents are dealt into ``FOLDS`` folds by their id. A trusted document is judged by the model of the other folds,
every other document by the model of all, so a threshold rests on text that its model has not seen.

1. One pass over the documents counts the grams of trusted ones by fold and lists the distinct grams that each block of
   the input (a split of a file) asks of each model.
2. Counts become continuation counts order by order, discounts come from counts of counts, and the distinct grams of the
   corpus get their probability by joins with the sharded count tables, lowest order first. All models go through the same joins, in columns of their own; tables are dealt by gram.
3. Each block's grams go back with their log-probabilities to files sorted by block, in at most ``FOLDERS`` folders; a second pass
   over the documents looks them up there. No text is shuffled while the trusted ids can be broadcast (beyond that the
   flagged documents are written once), no table is gathered on the driver, and what a task holds is one block's distinct
   grams.
4. A document stays if its perplexity is at most the given quantile of the trusted documents of its language (of
   all its documents, where none is trusted).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import BROADCAST_BYTES, tidy, tune
from litsieve.llm.files import locate
from litsieve.storage import drop, fresh_dir, let_go, materialize, remove_tree, scratch

ORDER, QUANTILE, FOLDS = 5, 0.99, 2
#: Most folders of answers.
FOLDERS = 4096
#: Bytes of text whose grams are sorted at once, and distinct grams a task holds before it hands them on.
CHUNK, HELD = 2 << 20, 1_000_000


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte, the start padded with zero bytes."""
    b = np.frombuffer(b"\x00" * (order - 1) + raw, dtype=np.uint8).astype(np.int64)
    n = len(b) - order + 1
    out = b[:n].copy()
    for k in range(1, order):
        out <<= 8
        out |= b[k : k + n]
    return out


class _Tally:
    """Distinct grams with counts, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size > 2 * HELD:
            self._merge()

    def _merge(self) -> None:
        k = np.concatenate([p[0] for p in self.parts])
        c = np.concatenate([p[1] for p in self.parts])
        names, at = np.unique(k, return_inverse=True)
        self.parts = [(names, np.bincount(at, c, len(names)).astype(np.int64))]
        self.size = len(names)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def _first_pass(order: int, folds: int):
    """Rows: doc_id, block, text, model. Gives ``block, gram, n0 .. n<folds>``: how often the block's documents of each model have it."""
    schema = pa.schema([("block", pa.int64()), ("gram", pa.int64()), *((f"n{m}", pa.int64()) for m in range(folds + 1))])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[tuple[int, int], _Tally] = {}

        def out(block: int) -> pa.RecordBatch:
            own = {m: tallies.pop((block, m)).take() for m in range(folds + 1) if (block, m) in tallies}
            k = np.unique(np.concatenate([keys for keys, _ in own.values()]))
            n = np.zeros((folds + 1, len(k)), dtype=np.int64)
            for m, (keys, counts) in own.items():
                n[m, np.searchsorted(k, keys)] = counts
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, dtype=np.int64)), pa.array(k), *map(pa.array, n)], schema=schema)

        for b in parts:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                groups: dict[tuple[int, int], list[bytes]] = {}
                for block, text, model in zip(*(c.to_pylist() for c in some.columns[1:4]), strict=True):
                    groups.setdefault((block, model), []).append((text or "").encode("utf-8", "surrogatepass"))
                for key, raws in groups.items():
                    tally = tallies.setdefault(key, _Tally())
                    held, size = [], 0
                    for raw in raws:
                        held.append(grams(raw, order))
                        size += len(raw)
                        if size > CHUNK:
                            tally.add(np.concatenate(held))
                            held, size = [], 0
                    if held:
                        tally.add(np.concatenate(held))
                if sum(t.size for t in tallies.values()) > 4 * HELD:
                    for block in {x for x, _ in tallies}:
                        yield out(block)
        for block in {x for x, _ in tallies}:
            yield out(block)

    return run


def discounts(counts: DataFrame) -> list[tuple[float, float, float]]:
    """D1, D2, D3+ of each model (columns c0, c1 ..) from how many of its grams have counts 1 to 4 (one row)."""
    names = [c for c in counts.columns if c != "gram"]
    row = counts.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4)]).first()
    return [discounts_of(*row[4 * k : 4 * k + 4]) for k in range(len(names))]


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in zip((1, 2, 3), raw, strict=True))


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c >= 3, d[2]).when(c == 2, d[1]).when(c == 1, d[0]).otherwise(0.0)


def probabilities(wanted: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, l0, l1 ..``: log-probabilities of the wanted grams under the models whose counts are ``gram, c0, c1 ..``.

    ``wanted``: ``gram, a0, a1 ..``, whether each model is asked for it; what is not asked is null.

    Each order is two joins of the wanted grams: with the order's counts by gram and with its totals by context. All models
    go through the same joins, in columns of their own.
    """
    models = range(len(counts.columns) - 1)
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        lower = tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(*[F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"c{m}") for m in models])
        tables[k] = materialize(lower, f"order{k}")
        let_go(counts.sparkSession)
    q = wanted.select("gram", *[F.when(F.col(f"a{m}"), F.lit(1 / 256)).alias(f"p{m}") for m in models])
    for k in range(1, order + 1):
        t, mask = tables[k], (1 << 8 * k) - 1
        d = discounts(t)
        per = t.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(*[x for m in models for x in (F.sum(f"c{m}").alias(f"total{m}"), F.sum(_discount(F.col(f"c{m}"), d[m])).alias(f"mass{m}"))])
        q = q.withColumns({"g": F.col("gram").bitwiseAND(F.lit(mask)), "ctx": F.shiftright(F.col("gram").bitwiseAND(F.lit(mask)), 8)})
        q = q.join(t.withColumnRenamed("gram", "g"), "g", "left").join(per, "ctx", "left")

        def p(m: int, d=d) -> Column:
            c, total = F.coalesce(f"c{m}", F.lit(0)), F.col(f"total{m}")
            own = F.greatest(c - _discount(c, d[m]), F.lit(0.0))
            return F.when(F.coalesce(total, F.lit(0)) == 0, F.col(f"p{m}")).otherwise(own / total + F.col(f"mass{m}") / total * F.col(f"p{m}")).alias(f"p{m}")

        q = q.select("gram", *[p(m) for m in models])
    return q.select("gram", *[F.log(f"p{m}").alias(f"l{m}") for m in models])


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(folds)).cast("int")


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Both passes cut files alike, also where the number of executors changes between them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _own(docs: DataFrame, *more: str) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    block = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), block.alias("block"), F.col("text").cast("string").alias("text"), lang.alias("lang"), *more)


def _from_files(docs: DataFrame) -> DataFrame:
    """The rows as they lie in files; rows that come from elsewhere are written first."""
    try:
        return _own(docs)
    except AnalysisException:
        return _own(materialize(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]), "documents"))


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """``doc_id, lang, trusted, n_bytes, perplexity`` of every row; ``trusted``: doc_id of trusted documents."""
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark) as keep, _same_splits(spark):
        ids = materialize(trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("good", F.lit(True)), "trusted")
        if ids.count() * 32 <= BROADCAST_BYTES:
            own = _from_files(docs).join(F.broadcast(ids), "doc_id", "left")
        else:
            flagged = materialize(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]).join(ids, "doc_id", "left"), "flagged")
            own = _own(flagged, "good")
        own = own.withColumn("model", F.when(F.col("good"), fold_of(F.col("doc_id"), folds)).otherwise(F.lit(folds)))
        models = range(folds + 1)
        kinds = ", ".join(["block long, gram long", *(f"n{m} long" for m in models)])
        seen = materialize(own.select("doc_id", "block", "text", "model").mapInArrow(tidy(_first_pass(order, folds)), kinds), "grams")
        let_go(spark)
        # a model's counts are those of all folds but its own; the last one's are all
        others = lambda m: reduce(Column.__add__, [F.col(f"n{f}") for f in range(folds) if f != m], F.lit(0))
        trained = reduce(Column.__or__, [F.col(f"n{f}") > 0 for f in range(folds)])
        counts = materialize(seen.where(trained).groupBy("gram").agg(*[F.sum(others(m)).alias(f"c{m}") for m in models]), "counts")
        let_go(spark)
        wanted = seen.groupBy("gram").agg(*[F.max(F.col(f"n{m}") > 0).alias(f"a{m}") for m in models])
        known = materialize(probabilities(wanted, counts, order), "logp")
        let_go(spark)
        # what a block asks of a model; the rest stays null
        asked = seen.join(known, "gram").select("block", "gram", *[F.when(F.col(f"n{m}") > 0, F.col(f"l{m}")).alias(f"l{m}") for m in models])
        asked = materialize(asked, "asked")
        drop(seen)
        drop(known)
        let_go(spark)
        blocks, rows = asked.agg(F.count_distinct("block"), F.count("*")).first()
        folders = max(1, min(FOLDERS, blocks))
        uri = fresh_dir(spark, "answers")
        # several tasks for a folder of many rows
        dealt = asked.withColumn("bucket", F.pmod("block", F.lit(folders))).repartition("bucket", F.pmod(F.xxhash64("gram"), F.lit(1 + rows // (folders * 2 * HELD))))
        dealt.sortWithinPartitions("bucket", "block", "gram").write.partitionBy("bucket").parquet(uri)
        drop(asked)
        let_go(spark)
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_bytes", pa.int64()), ("perplexity", pa.float64())])

        def score(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, keys, logp = None, None, None
            for b in parts:
                out = []
                for doc_id, block, text, tongue, model in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    value = None
                    if raw:
                        if block != at:
                            keys = logp = None  # before the next ones come
                            at = block
                            keys, logp = _answers(f"{uri}/bucket={block % folders}", block, folds + 1)
                        own = grams(raw, order)
                        place = np.searchsorted(keys, own)
                        if place.max() >= len(keys) or (keys[place] != own).any() or np.isnan(mean := logp[model][place].mean()):
                            raise RuntimeError("the files were split otherwise than in the first pass")
                        value = float(np.exp(-mean))
                    out.append((doc_id, tongue, model < folds, len(raw), value))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        # the files' own order is kept, so a task changes its answers when its block changes
        scored = own.select("doc_id", "block", "text", "lang", "model").mapInArrow(tidy(score), "doc_id long, lang string, trusted boolean, n_bytes long, perplexity double")
        scored = keep(materialize(scored, "perplexity"))
        remove_tree(spark, uri)
    return scored


def _answers(folder: str, block: int, models: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's distinct grams in order and their log-probabilities by model, nan where none was asked."""
    fs, path = locate(folder)
    names = [f"l{m}" for m in range(models)]
    t = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["gram", *names], filter=ds.field("block") == block)
    k = t.column("gram").to_numpy()
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    value = lambda c: np.asarray(t.column(c).to_numpy(), dtype=float)[order]
    return k[first], [np.fmax.reduceat(value(c), first) if len(first) else np.zeros(0) for c in names]


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, keep`` for every row.

    Thresholds are ``percentile_approx`` (bounded memory; exact up to its accuracy of 10,000) by language, of trusted
    documents under models that did not learn from them. A null or empty text has a null perplexity and is not kept; a null
    language is a language of its own; rows with a null or repeated doc_id are each judged. Without trusted text every byte
    is as likely as any other. An empty table gives no rows. Other columns are not read. Rows that don't come from files are
    written to the shared folder first.
    """
    scored = perplexities(docs, trusted, order, folds)
    near = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(10_000))
    limits = scored.groupBy("lang").agg(F.coalesce(near(F.when(F.col("trusted"), F.col("perplexity"))), near(F.col("perplexity"))).alias("threshold"))
    limits = F.broadcast(limits.withColumnRenamed("lang", "__lang")) if scored.select("lang").distinct().count() <= 10_000 else limits.withColumnRenamed("lang", "__lang")
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def op2_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels.where("quality = 1 and toxic = 0"))
