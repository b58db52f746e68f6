"""The registered cross validation runs the method's whole ensemble."""

import inspect

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from litsieve.operators import relevance
from litsieve.plans import catalogue


class Asked(Exception):
    pass


def test_the_query_takes_all_classifiers_folds_and_bags(spark, sf, monkeypatch):
    whole = inspect.signature(relevance.cross_validate)

    def asked(*args, **kwargs):
        given = whole.bind(*args, **kwargs)
        given.apply_defaults()
        raise Asked(*(given.arguments[c] for c in ("use", "k", "bags", "share", "trees")))

    monkeypatch.setattr(relevance, "cross_validate", asked)
    with pytest.raises(Asked) as e:
        catalogue.queries()["relevance_cv"](spark, sf)
    assert e.value.args == (None, 5, 10, 0.8, 100)
    assert len(relevance.classifiers()) == 7


def test_models_side_by_side_give_what_they_give_in_turn(spark):
    i = F.col("id")
    label = F.when(i % 4 == 3, "unknown").when(i % 4 == 0, "relevant").when(i % 4 == 1, "irrelevant").otherwise("borderline")
    data = spark.range(120, numPartitions=2).select("id", array_to_vector(F.array(i % 4 + F.sin("id"), F.cos("id"), F.sin(i * 7))).alias("features"), label.alias("label"))
    rows = []
    for n in (1, 6):
        preds, metrics = relevance.cross_validate(data, "id", use=["naive_bayes", "decision_tree", "logistic_regression"], k=3, bags=1, parallelism=n)
        assert preds.count() == 3 * 120
        rows.append((sorted(map(tuple, preds.collect())), sorted(map(tuple, metrics.collect()))))
    assert rows[0] == rows[1]
