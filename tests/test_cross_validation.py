"""What judging a classifier's folds reads and counts."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from litsieve.operators import relevance


@pytest.fixture
def judged(monkeypatch):
    """The frames that were given to the evaluator."""
    seen, own = [], MulticlassClassificationEvaluator.evaluate
    monkeypatch.setattr(MulticlassClassificationEvaluator, "evaluate", lambda self, df, *x: seen.append(df) or own(self, df, *x))
    return seen


def table(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    label = F.when(F.col("id") % 4 == 3, "unknown").when(F.col("id") % 4 == 0, "relevant").when(F.col("id") % 4 == 1, "irrelevant").otherwise("borderline")
    return rows.select("id", array_to_vector(F.array(F.col("id") % 4 + F.rand(1), F.rand(2), F.rand(3))).alias("features"), label.alias("label"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_are_judged_from_tables_without_a_join_of_the_labels(spark, judged):
    preds, metrics = relevance.cross_validate(table(spark, range(80)), "id", use=["naive_bayes"], k=2, bags=2)
    assert len(judged) == 4 and not any("Join" in plan(df) or "Exchange" in plan(df) for df in judged)
    assert "Exchange" not in plan(preds)
    assert preds.count() == preds.select("id").distinct().count() == 80


def test_each_labelled_row_is_judged_once(spark, judged):
    ids = [*range(80), *[4] * 5, *[6] * 3, *[7] * 2]  # repeated keys fall into both folds
    relevance.cross_validate(table(spark, ids), "id", use=["naive_bayes"], k=2, bags=2)
    one = judged[0].withColumn("n", F.col("n") if "n" in judged[0].columns else F.lit(1))
    assert {r["y"]: r["n"] for r in one.groupBy("y").agg(F.sum("n").alias("n")).collect()} == {0.0: 23, 1.0: 20, 2.0: 25}
