"""Operator 11: mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix should hold it. Among all rates between 0 and
``cap`` whose words meet each source's target, the chosen ones have the least relative entropy to the
base rate. The optimum is an exponential tilt of the odds,

    rate = cap / (1 + (cap / base - 1) * exp(-tilt * size / scale)),

with one tilt for each source, and the tilts maximise a concave dual. Its gradient and curvature are sums
over documents, so each Newton step is one aggregation that Spark runs over the table of (source, size, how
many), and what a step changes is a table with one row for each source; nothing of it passes the driver but
how many sources are still open. Steps that leave the interval in which the root is known to lie are
halved. Sums are decimal, so they don't depend on the order in which tasks end and reruns agree.

Rates are rounded into copies by carrying each source's remainder from long documents to short ones, over
the same table; which documents of equal source and size get the extra copy is settled by a hash of
their ids, ranked in buckets so that no size or source is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import shuffle_width
from litsieve.schema import numbered
from litsieve.storage import bounded, materialize

SHARES, FACTOR, CAP, BASE = (5, 2, 1), 1.5, 2, 1.0
WORD = r"[^\x20\x09-\x0D]+"
#: A source is settled when its words are this near its target, or after so many steps (the rounding makes up the rest).
NEAR, STEPS = 1e-7, 60
_SUM = "decimal(38,10)"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the number of words of the text, 0 for a null one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(hist: DataFrame, shares: Sequence[float] = SHARES, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """``source, place, source_size, target, scale`` of each source: its number by code point (null last), its words, and its share of
    ``factor`` times all words by weight, at most ``cap`` times its own.

    What a source cannot take is shared again among the others by weight until none is above.
    """
    own = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), (F.sum((F.col("n") * F.col("size")).cast("double") * F.col("size"))).alias("squares"))
    t = numbered(own.withColumn("none", F.col("source").isNull()), ["none", "source"], "place").drop("none")
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.col("place") % len(shares) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        above = F.col("most") <= level * F.col("weight")
        held, rest, n = t.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == stopped or not rest:
            break
        level, stopped = max(factor * total - cap * (held or 0), 0.0) / rest, n
    full = F.col("most") <= level * F.col("weight")
    return t.select("source", "place", "source_size", F.when(full, F.col("most")).otherwise(level * F.col("weight")).alias("target"), F.when(F.col("squares") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0).alias("scale"))


def rate(size: Column, tilt: Column, cap: float, base: float) -> Column:
    """The tilted rate of a document; the exponent is kept where doubles can hold it."""
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size))
    return cap / (1 + (cap / base - 1) * F.exp(-z))


def tilts(hist: DataFrame, sources: DataFrame, cap: float = CAP, base: float = BASE) -> DataFrame:
    """``place, tilt`` of each source by Newton steps on the dual; ``hist`` has ``place, size, n``.

    A source whose target is its cap, or that has no words, has no finite tilt and is not in the result.
    """
    start = sources.where((F.col("target") < cap * F.col("source_size")) & (F.col("target") > 0))
    state = start.select("place", "target", "scale", F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(False).alias("settled"))
    state = bounded(state, "tilts")
    x = F.col("size") / F.col("scale")
    r = rate(x, F.col("tilt"), cap, base)
    for _ in range(STEPS):
        words = F.col("n") * F.col("size") * r
        # settled sources take no part in a step
        moved = hist.join(state.where(~F.col("settled")), "place").groupBy("place").agg(F.sum(words.cast(_SUM)).cast("double").alias("words"), F.sum((words * x * (1 - r / cap)).cast(_SUM)).cast("double").alias("curve"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("curve") > 0, -gap / F.col("curve")).otherwise(-F.signum(gap) * float("inf"))
        far = 4 * F.greatest(F.lit(1.0), F.abs("tilt"))
        newton = F.col("tilt") + F.greatest(-far, F.least(far, step))
        inside = (newton > F.col("l")) & (newton < F.col("h"))
        next_ = F.when(inside, newton).when((F.col("l") > float("-inf")) & (F.col("h") < float("inf")), (F.col("l") + F.col("h")) / 2).otherwise(newton)
        done = F.col("words").isNull() | (F.abs(gap) <= NEAR * F.col("target"))
        new = state.join(moved, "place", "left").withColumn("l", low).withColumn("h", high)
        state = bounded(
            new.select("place", "target", "scale", F.when(done, F.col("tilt")).otherwise(next_).alias("tilt"), F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"), F.coalesce(done, F.lit(True)).alias("settled")),
            "tilts",
        )
        if not state.where(~F.col("settled")).count():
            break
    return state.select("place", "tilt")


def rounded(group: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies of all documents of each size of one source: long ones first, what rounding leaves goes to the next size."""
    group = group.sort_values("size", ascending=False)
    out, owed = np.zeros(len(group), dtype=np.int64), 0.0
    for k, (size, n, r) in enumerate(zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), strict=True)):
        want = n * r + (owed / size if size else 0.0)
        out[k] = min(max(int(np.floor(want + 0.5)), 0), cap * n)
        owed = (want - float(out[k])) * size
    return group[["place", "size", "n"]].assign(copies=out)


def mixture(docs: DataFrame, shares: Sequence[float] = SHARES, factor: float = FACTOR, cap: int = CAP, base: float = BASE) -> DataFrame:
    """One row for each different ``doc_id, source, size``: how many documents it stands for (``rows``), the copies each of them
    gets (``copies``) and how many of them get one more (``extra``), with ``source_size`` and ``target``.

    A source has at most as many sizes as its longest document has words; that table, and not the documents, is rounded by one
    task a source.
    """
    keys = materialize(sized(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-keys")
    hist = keys.groupBy("source", "size").agg(F.sum("rows").alias("n"))
    hist = materialize(hist, "mix-sizes")
    sources = bounded(source_targets(hist, shares, factor, cap), "mix-sources")
    spread = materialize(hist.join(sources, hist["source"].eqNullSafe(sources["source"])).select("place", "size", "n"), "mix-sizes-placed")
    tilt = tilts(spread, sources, cap, base)
    rates = spread.join(bounded(sources.join(tilt, "place", "left").select("place", "source_size", "target", "scale", "tilt"), "mix-tilts"), "place")
    full = F.when(F.col("target") <= 0, 0.0).otherwise(float(cap))
    rates = rates.select("place", "size", "n", F.when(F.col("tilt").isNull(), full).otherwise(rate(F.col("size") / F.col("scale"), F.col("tilt"), cap, base)).alias("rate"))
    whole = materialize(rates.groupBy("place").applyInPandas(lambda g: rounded(g, cap), "place long, size long, n long, copies long"), "mix-copies")

    placed = keys.join(sources, keys["source"].eqNullSafe(sources["source"])).select("doc_id", keys["source"], "size", "rows", "place", "source_size", "target")
    ranked = _before(placed)
    one = F.when(F.col("n") > 0, F.floor(F.col("copies_all") / F.col("n"))).otherwise(0)
    more = F.col("copies_all") - one * F.col("n")
    return ranked.join(whole.withColumnRenamed("copies", "copies_all"), ["place", "size"]).select(
        "doc_id", "source", "size", "rows", "source_size", "target", one.cast("long").alias("copies"), F.greatest(F.lit(0), F.least(F.col("rows"), more - F.col("before"))).cast("long").alias("extra")
    )


def _before(keys: DataFrame) -> DataFrame:
    """Add ``before``: documents of the same source and size that come earlier by a hash of the id."""
    buckets = shuffle_width(keys.sparkSession)
    t = materialize(keys.withColumn("h", F.xxhash64("doc_id", "source", "size")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), "mix-buckets")
    earlier = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = t.groupBy("place", "size", "bucket").agg(F.sum("rows").alias("own"))
    base = counts.select("place", "size", "bucket", earlier("own", ["place", "size"], ["bucket"]).alias("base"))
    inside = t.withColumn("inside", earlier("rows", ["place", "size", "bucket"], ["h", "doc_id"]))
    return inside.join(base, ["place", "size", "bucket"]).withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside", "bucket", "h")


def mix(docs: DataFrame, shares: Sequence[float] = SHARES, factor: float = FACTOR, cap: int = CAP, base: float = BASE) -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target, copies, taken``.

    Sources are numbered by code point, null last, and weigh as ``shares`` repeat. A null text has no words; rows that
    share doc_id, source and size (null ids too) are documents of their own; an empty table gives no rows; sources
    without words have the target 0; other columns are not looked at.
    """
    each = mixture(docs, shares, factor, cap, base).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copies = F.col("copies") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as its copies say; columns stay."""
    plan = mixture(docs, **settings).select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("rows").alias("__rows"), F.col("copies").alias("__copies"), F.col("extra").alias("__extra"))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.withColumn("__own", size)
    met = own.join(plan, own["doc_id"].cast("long").eqNullSafe(plan["__doc"]) & own["source"].cast("string").eqNullSafe(plan["__source"]) & (own["__own"] == plan["__size"]))
    alone, several = met.where(F.col("__rows") == 1).withColumn("__nth", F.lit(1)), met.where(F.col("__rows") > 1)
    several = several.withColumn("__nth", F.row_number().over(Window.partitionBy("__doc", "__source", "__size").orderBy("text")))
    times = F.col("__copies") + F.when(F.col("__nth") <= F.col("__extra"), 1).otherwise(0)
    out = alone.unionByName(several).withColumn("__times", times).where(F.col("__times") > 0)
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op11_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
