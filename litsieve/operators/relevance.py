"""Relevance from human labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import cluster_members, text
from litsieve.functions.vectors import cosine, with_range
from litsieve.schema import numbered
from litsieve.storage import materialize

CLASSES = ("borderline", "irrelevant", "relevant")


def user_clusters(review: DataFrame) -> DataFrame:
    """``cluster, label`` of judged clusters (R, I, B in any case; merged ids are expanded)."""
    u = F.upper(F.trim(text("user_judgment")))
    label = F.when(u == "R", "relevant").when(u == "I", "irrelevant").when(u == "B", "borderline")
    return review.select(F.explode(cluster_members(F.col("cluster_id").cast("string"))).alias("cluster"), label.alias("label")).where("label is not null")


def label_articles(articles: DataFrame, judged: DataFrame) -> DataFrame:
    """L2: an article's label by its cluster; of several the last in the order relevant, irrelevant, borderline."""
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("relevant", 0, "irrelevant", 1, "borderline", 2)]), F.col("label"))
    one = judged.groupBy("cluster").agg(F.max_by("label", rank).alias("label"))
    return articles.withColumn("__c", F.col("cluster").cast("string")).join(one.withColumnRenamed("cluster", "__c"), "__c", "left").drop("__c").withColumn("label", F.coalesce("label", F.lit("unknown")))


def features(articles: DataFrame, centroids: DataFrame, coherence: DataFrame, vector: str, key: str) -> DataFrame:
    """L3: the vector, its distance to the own centroid, the cluster's coherence (0 if none), and the largest cosine to a relevant document.

    Rows without a cluster have distance 1 and weight 0; where no document is relevant the similarity is 0.
    """
    c = centroids.select("cluster", "centroid")
    w = coherence.select("cluster", F.col("coherence").alias("coherence_weight"))
    out = articles.join(c, "cluster", "left").join(w, "cluster", "left")
    out = out.withColumns({"distance_to_centroid": F.coalesce(1 - cosine(F.col(vector), F.col("centroid")), F.lit(1.0)), "coherence_weight": F.coalesce("coherence_weight", F.lit(0.0))}).drop("centroid")
    near = max_cosine(articles.select(key, vector), articles.where("label = 'relevant'").select(vector), key, vector).withColumnRenamed("cosine", "similarity_to_relevant")
    return out.join(near, key, "left").withColumn("similarity_to_relevant", F.coalesce("similarity_to_relevant", F.lit(0.0)))


#: Rows of the smaller side that meet the whole table at once, and rows of the table in one product with them.
BLOCK, ROWS = 4096, 512


def _largest(x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Each row's largest cosine to unit ``targets``; no product is larger than ``ROWS`` times the targets."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.concatenate([(unit[at : at + ROWS] @ targets.T).max(axis=1) for at in range(0, len(unit), ROWS)])


def max_cosine(points: DataFrame, targets: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, cosine``: each point's largest cosine to any target; null without targets, 0 for a zero vector.

    Targets (documents that people have judged) go out in blocks of ``BLOCK`` rows, one matrix product for each block and
    slice of points, so a worker holds one block and a product of ``ROWS`` rows, whatever the batch; more targets are more blocks.
    """
    doubles = F.transform(vector, lambda v: v.cast("double")).alias("v")
    side = materialize(numbered(targets.where(F.col(vector).isNotNull()).select(doubles), ["v"], "at"), "targets")
    n = side.count()
    mine = points.where(F.col(vector).isNotNull()).select(key, doubles)
    kind = points.schema[key].dataType.simpleString()
    out = None
    for start in range(0, n, BLOCK):
        rows = np.array([r.v for r in side.where(F.col("at").between(start, start + BLOCK - 1)).collect()])  # one block
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        shared = points.sparkSession.sparkContext.broadcast(np.divide(rows, size, out=np.zeros_like(rows), where=size > 0))

        def run(parts, shared=shared):
            for pdf in parts:
                if len(pdf):
                    yield pd.DataFrame({key: pdf[key], "cosine": _largest(np.array(pdf["v"].tolist(), dtype=float), shared.value)})

        part = mine.mapInPandas(run, f"{key} {kind}, cosine double")
        part = part if out is None else out.unionByName(part)
        out = materialize(part.groupBy(key).agg(F.max("cosine").alias("cosine")), "largest")  # one row a key, however many blocks
        shared.destroy()
    return mine.select(key, F.lit(None).cast("double").alias("cosine")) if out is None else out


def folds(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: rows numbered by label and hash of the key, in no single task, and dealt in turn."""
    placed = numbered(df.withColumn("__h", F.xxhash64(key, F.lit(seed))), [label, "__h", key], "__at")
    return placed.withColumn("fold", (F.col("__at") % k).cast("int")).drop("__h", "__at")


def classifiers(seed: int = 42, trees: int = 100) -> dict:
    """L4's seven: MLlib's, and a kernel machine and multi-class boosting of this library."""
    from pyspark.ml import classification as C

    from litsieve.operators.learners import KernelMachine, SoftmaxBoosting

    return {
        "random_forest": C.RandomForestClassifier(numTrees=trees, seed=seed),
        "gradient_boosting": SoftmaxBoosting(rounds=trees, seed=seed),
        "svc": KernelMachine(seed=seed),
        "naive_bayes": C.NaiveBayes(modelType="gaussian"),
        "logistic_regression": C.LogisticRegression(maxIter=100),
        "decision_tree": C.DecisionTreeClassifier(seed=seed),
        "ovr_forest": C.OneVsRest(classifier=C.RandomForestClassifier(numTrees=trees, seed=seed)),
    }


def _probabilities(model, df: DataFrame, n_classes: int, names: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.select("*", *[p[i].alias(f"p_{names[i]}") for i in range(n_classes)])
    raw = vector_to_array("rawPrediction")
    top = F.exp(raw[0]) + sum((F.exp(raw[i]) for i in range(1, n_classes)), F.lit(0.0))
    return out.select("*", *[(F.exp(raw[i]) / top).alias(f"p_{names[i]}") for i in range(n_classes)])


def cross_validate(df: DataFrame, key: str, features_col: str = "features", label: str = "label", use: list[str] | None = None, k: int = 5, bags: int = 10, seed: int = 42, share: float = 0.8, trees: int = 100, parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities ``key, classifier, p_<class>`` of labelled rows, and each classifier's metrics.

    Unlabelled rows get a final model's probabilities (D11). With ``bags`` over 1 every model but the logistic one is
    the mean over bags, each of a ``share`` of the rows and of the features.

    A fold's predictions are a table with how many rows of each class a key has, so labels are never joined (nor broadcast) to
    judge them, each labelled row is judged once, by its own fold, and no plan holds the models of more than one fold. As many folds
    and final models as ``parallelism`` says are fitted side by side, each from the whole table by Spark jobs of its own.
    """
    import random
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorSlicer

    known = folds(df.where(F.col(label) != "unknown"), key, label, k, seed)
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(known)
    names = list(index.labels)
    data = index.transform(known).select(key, "fold", "y", F.col(features_col).alias("features"))
    data = materialize(data, "labelled")
    unknown = df.where(F.col(label) == "unknown").select(key, F.col(features_col).alias("features"))
    n_features = len(data.first()["features"]) if data.head(1) else 0
    preds, metrics = [], []
    cols, seen = [f"p_{c}" for c in names], [f"n_{c}" for c in names]
    used = {name: est for name, est in classifiers(seed, trees).items() if not use or name in use}

    def fitted(name: str, fold: int | None) -> DataFrame:
        """``key, p_<class>`` of a fold, or of the unlabelled rows; if the rows have labels also ``n_<class>``, the key's rows of each class."""
        est = used[name].copy({})
        est.setParams(featuresCol="features", labelCol="y") if hasattr(est, "setParams") else None
        train, test = (data, unknown) if fold is None else (data.where(F.col("fold") != fold), data.where(F.col("fold") == fold))
        outs = []
        for b in range(bags if name != "logistic_regression" else 1):
            if bags == 1 or name == "logistic_regression":
                outs.append(_probabilities(est.fit(train), test, len(names), names))
                continue
            some = sorted(random.Random(seed + b).sample(range(n_features), max(1, round(share * n_features))))
            cut = VectorSlicer(inputCol="features", outputCol="x", indices=some)
            own = lambda df, cut=cut: cut.transform(df).drop("features").withColumnRenamed("x", "features")
            outs.append(_probabilities(est.fit(own(train.sample(share, seed=seed + b))), own(test), len(names), names))
        y = F.col("y") if "y" in test.columns else F.lit(None)
        every = outs[0].select(key, *cols, y.cast("double").alias("y"))
        for o in outs[1:]:  # rows are counted once, in the first bag
            every = every.unionByName(o.select(key, *cols, F.lit(None).cast("double").alias("y")))
        counts = [F.count(F.when(F.col("y") == i, 1)).alias(n) for i, n in enumerate(seen)] if "y" in test.columns else []
        return materialize(every.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols], *counts), "predicted")

    asked = [(name, f) for name in used for f in [*range(k), None]]
    with ThreadPool(max(1, min(parallelism, len(asked)))) as pool:
        parts = dict(zip(asked, pool.map(inheritable_thread_target(df.sparkSession)(lambda x: fitted(*x)), asked, chunksize=1), strict=True))
    for name in used:
        out = parts[name, 0]
        for f in range(1, k):
            out = out.unionByName(parts[name, f])
        best = F.array_position(F.array(*cols), F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])) - 1
        weights = F.array(*[F.struct(F.lit(float(i)).alias("y"), F.col(n).cast("double").alias("n")) for i, n in enumerate(seen)])
        judged = out.select(best.cast("double").alias("prediction"), F.inline(weights)).where("n > 0")
        row = [name]
        for metric in ("accuracy", "weightedPrecision", "weightedRecall", "f1"):
            row.append(MulticlassClassificationEvaluator(labelCol="y", weightCol="n", metricName=metric).evaluate(judged))
        metrics.append(tuple(row))
        preds.append(out.select(key, *cols, F.lit(name).alias("classifier")))
        preds.append(parts[name, None].withColumn("classifier", F.lit(name)))
    table = preds[0]
    for p in preds[1:]:
        table = table.unionByName(p)
    for c in CLASSES:  # a class that no one labelled has probability 0 (D30)
        if f"p_{c}" not in table.columns:
            table = table.withColumn(f"p_{c}", F.lit(0.0))
    return table, df.sparkSession.createDataFrame(metrics, "classifier string, accuracy double, precision double, recall double, f1 double")


def blend(predictions: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Class probabilities weighted by F1; ``classifier_score = P(relevant) - P(irrelevant)``."""
    w = predictions.join(F.broadcast(metrics.select("classifier", "f1")), "classifier")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("f1")), F.sum("f1")), F.avg(c))
    out = w.groupBy(key).agg(*[mean(f"p_{c}").alias(f"p_{c}") for c in CLASSES])
    return out.withColumn("classifier_score", F.col("p_relevant") - F.col("p_irrelevant"))


def final_scores(blended: DataFrame) -> DataFrame:
    """Half the min-max classifier score, half the min-max of ``P(relevant) - (similarity * coherence)^(1/8)`` to the nearest irrelevant cluster (clamped at 0, D11; nulls are 0).

    Needs ``irrelevant_similarity`` and ``irrelevant_coherence``.
    """
    near = F.pow(F.greatest(F.col("irrelevant_similarity") * F.col("irrelevant_coherence"), F.lit(0.0)), F.lit(1 / 8))
    b = with_range(blended.withColumn("__m", F.col("p_relevant") - near), "classifier_score", "__m")
    mm = lambda c: F.try_divide(F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min"))
    score = F.coalesce(0.5 * mm("classifier_score") + 0.5 * mm("__m"), F.lit(0.0))
    return b.withColumn("final_score", score).drop("__m", "__m_min", "__m_max", "classifier_score_min", "classifier_score_max")


def score_limits(df: DataFrame, score: str = "final_score", centres: tuple[float, float] | None = None) -> DataFrame:
    """L6's limits: mean of ``mean -+ sd`` and the outer centres of a 3-means on the score."""
    if centres is None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        v = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(score).where(F.col(score).isNotNull()))
        found = sorted(float(c[0]) for c in KMeans(k=3, seed=42).fit(v).clusterCenters())
        centres = (found[0], found[-1])
    return df.agg(((F.avg(score) - F.stddev_samp(score) + F.lit(centres[0])) / 2).alias("lower"), ((F.avg(score) + F.stddev_samp(score) + F.lit(centres[1])) / 2).alias("upper"))


def categorise(df: DataFrame, limits: DataFrame, score: str = "final_score") -> DataFrame:
    """At or under lower Irrelevant, at or over upper Relevant, else Borderline."""
    c = F.when(F.col(score) <= F.col("lower"), "Irrelevant").when(F.col(score) >= F.col("upper"), "Relevant").otherwise("Borderline")
    return df.crossJoin(F.broadcast(limits)).withColumn("category", c).drop("lower", "upper")


def prefill(df: DataFrame, matches: Column, score: str = "final_score") -> DataFrame:
    """K for relevant, D for irrelevant unless the query matches, borderline K from their median up; in rising score order."""
    med = df.where("category = 'Borderline'").agg(F.percentile(score, F.lit(0.5)).alias("__med"))
    u = F.when(F.col("category") == "Relevant", "K").when(F.col("category") == "Irrelevant", F.when(matches, "K").otherwise("D")).when(F.col(score) < F.col("__med"), "D").otherwise("K")
    return df.crossJoin(F.broadcast(med)).withColumn("user_judgment", u).drop("__med").orderBy(score)


def sample_by_category(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """A seeded random sample of each category."""
    w = Window.partitionBy("category").orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def with_predictions(data: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Predictions joined by id, without repeated columns."""
    return data.join(predictions.select(key, *[c for c in predictions.columns if c not in data.columns]), key)
