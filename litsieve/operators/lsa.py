"""The text space: TF-IDF, truncated SVD and top terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.storage import materialize


def tfidf(tokens: DataFrame, key: str, term: str = "term", max_df: float = 1.0, min_df: int = 1, n_docs: int | None = None) -> DataFrame:
    """V1: ``key, term, tf, tfidf``: raw tf, idf ``ln((1 + n) / (1 + df)) + 1``, rows of unit length.

    ``tokens`` has one row for each occurrence. ``max_df`` is a share of the documents, ``min_df`` a number
    (at least 1, D29).
    """
    tf = materialize(tokens.groupBy(key, term).agg(F.count("*").alias("tf")), "tf")  # read for the frequencies and for the weights
    df_ = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = F.lit(n_docs) if n_docs is not None else F.col("n")
    if n_docs is None:
        total = tf.agg(F.count_distinct(key).alias("n"))
        df_ = df_.crossJoin(F.broadcast(total))
    used = df_.where((F.col("df") >= max(1, min_df)) & (F.col("df") <= max_df * n)).withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1).select(term, "idf")
    w = tf.join(used, term).select(key, term, "tf", (F.col("tf") * F.col("idf")).alias("w"))
    # a document's weights meet once, for its norm and for whatever is ranked by document next
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, term, "tf", (F.col("w") / norm).alias("tfidf"))


def top_terms(weights: DataFrame, key: str, k: int, weight: str = "tfidf", term: str = "term") -> DataFrame:
    """The k heaviest terms of each key with their rank; ties to the term."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(weight, 9)), F.asc(term))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_concepts(df: DataFrame, key: str, vector: str, k: int = 5, filter_zeros: bool = True) -> DataFrame:
    """Each document's strongest concepts."""
    c = df.select(key, F.posexplode(vector).alias("concept", "weight"))
    c = c.where("weight <> 0") if filter_zeros else c
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "concept"))).where(F.col("rank") <= k)


def top_words_of(articles: DataFrame, components: DataFrame, key: str, n_terms: int = 10) -> DataFrame:
    """The union of the top terms of some articles' top concepts. ``components``: ``concept, term, weight``."""
    terms = top_terms(components, "concept", n_terms, "weight").select("concept", "term")
    return articles.join(terms, "concept").select(key, "term").distinct()


def drop_contained(terms: DataFrame, by: str, term: str = "term") -> DataFrame:
    """Terms of a group that are no part of another term of the group."""
    a, b = terms.alias("a"), terms.select(F.col(by).alias("_by"), F.col(term).alias("_t")).alias("b")
    return a.join(b, (F.col(f"a.{by}") == F.col("b._by")) & (F.col(f"a.{term}") != F.col("b._t")) & F.col("b._t").contains(F.col(f"a.{term}")), "left_anti")


class Lsa:
    """V3, V4: a fitted truncated SVD: ``components`` (k x terms), ``vocabulary``, kept variance ratios."""

    def __init__(self, vocabulary: list[str], components: np.ndarray, ratios: np.ndarray):
        self.vocabulary, self.components, self.ratios = vocabulary, components, ratios


def fit_lsa(weights: DataFrame, key: str, max_components: int = 250, min_ratio: float = 0.001, remove_first: bool = False, max_terms: int = 20_000) -> tuple[DataFrame, Lsa]:
    """V3, V4: ``key, vector`` (unit length) and the model.

    The Gram matrix route of ``RowMatrix``: rows stay distributed, only (terms x k) factors reach the driver, so
    the vocabulary is bounded by ``max_terms`` (an error beyond). Components after the last one that explains
    ``min_ratio`` of the variance go.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = weights.sparkSession
    weights = materialize(weights, "weights")
    vocab = [r[0] for r in weights.select("term").distinct().orderBy("term").limit(max_terms + 1).collect()]
    if len(vocab) > max_terms:
        raise ValueError(f"more than {max_terms} terms; raise min_df or lower max_df")
    at = spark.createDataFrame(list(enumerate(vocab)), "i int, term string")
    rows = weights.join(F.broadcast(at), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("tfidf").alias("w")))).alias("s"))
    rows = materialize(rows, "text-rows")
    width = len(vocab)
    vectors = rows.select("s.i", "s.w").rdd.map(lambda r: Vectors.sparse(width, r[0], r[1]))
    k = max(1, min(max_components, width - 1))
    matrix = RowMatrix(vectors, numCols=width)
    # every step of the solver reads all rows: they are kept as vectors, on disk where memory ends
    held = matrix._java_matrix_wrapper._java_model.rows().persist(spark._jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
    try:
        components = np.array(matrix.computeSVD(k).V.toArray()).T
    finally:
        held.unpersist(False)
    project = _projector(components)
    raw = materialize(rows.select(key, project(F.col("s")).alias("raw")), "projected")
    k = len(components)
    var = raw.agg(*[F.var_pop(F.col("raw")[i]).alias(f"v{i}") for i in range(k)]).first()
    total = weights.join(F.broadcast(at), "term").groupBy("i").agg(F.sum("tfidf").alias("s"), F.sum(F.col("tfidf") * F.col("tfidf")).alias("q")).crossJoin(F.broadcast(weights.agg(F.count_distinct(key).alias("n")))).agg(F.sum(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))).first()[0]
    ratios = np.array([v or 0.0 for v in var]) / (total or 1.0)
    strong = np.flatnonzero(ratios >= min_ratio)
    keep = int(strong[-1]) + 1 if len(strong) else 1
    from litsieve.functions.vectors import l2_normalise

    vec = F.slice("raw", 1, keep)
    if remove_first:
        vec = F.transform(vec, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))
    return raw.select(key, l2_normalise(vec).alias("vector")), Lsa(vocab, components[:keep], ratios[:keep])


def _projector(components: np.ndarray):
    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        out = []
        for row in s:
            i = [x["i"] for x in row]
            out.append((components[:, i] @ np.array([x["w"] for x in row])).tolist())
        return pd.Series(out)

    return project


def cluster_terms(centroids: DataFrame, model: Lsa, by: str = "cluster", k: int = 20) -> DataFrame:
    """Each cluster's heaviest terms by ``|centroid . components|``, without those inside another."""
    spark = centroids.sparkSession
    comps = spark.createDataFrame([(t, model.components[:, i].tolist()) for i, t in enumerate(model.vocabulary)], "term string, c array<double>")
    from litsieve.functions.vectors import dot

    scored = centroids.crossJoin(F.broadcast(comps)).select(by, "term", F.abs(dot(F.col("centroid"), F.col("c"))).alias("weight"))
    return drop_contained(top_terms(scored, by, k, "weight"), by)


def infrequent_terms(terms: DataFrame, by: str = "cluster", k: int = 20) -> DataFrame:
    """Terms that few clusters share (under half the largest count where that is over 7), the first k; all top terms where none is left."""
    n = terms.groupBy("term").agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("m")).withColumn("limit", F.when(F.col("m") > 7, F.floor(F.col("m") / 2)).otherwise(F.col("m")))
    counted = terms.join(n, "term").crossJoin(F.broadcast(top))
    few = counted.where("n < limit")
    none = counted.join(few.select(by).distinct(), by, "left_anti")
    both = few.unionByName(none)
    w = Window.partitionBy(by).orderBy("rank", "term")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(by, "term", "rank")


def terms_column(c: Column) -> Column:
    """A report line of terms."""
    return F.array_join(c, ", ")
