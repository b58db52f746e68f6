"""Where the toxicity classifier is fitted."""

from litsieve.llm import toxicity


def test_features_are_not_made_on_the_driver(spark, monkeypatch):
    rows = [(k, "vile scum" if k % 2 else "mild day") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    want = toxicity.fit(*toxicity.training_rows(docs, labels))

    def refuse(documents):
        raise AssertionError("features of texts on the driver")

    monkeypatch.setattr(toxicity, "Bags", refuse)
    got = toxicity.train(docs, labels)
    assert (got.theta == want.theta).all() and got.bias == want.bias and got.theta.any()
    assert toxicity.train(docs, labels.where("toxic = 0")).bias == -40.0
    assert toxicity.train(docs.limit(0), labels).bias == -40.0
