"""What the text queries write and shuffle."""

import re

from litsieve.operators import boilerplate, lsa


def shuffled_by(df):
    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_windows_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "a b c d e " * 8), (1, "a b c d e"), (2, None), (None, "x y z " * 20)], "id long, t string")
    found = boilerplate.repeated_windows(rows, "id", "t")
    assert all("term" not in x for x in shuffled_by(found))
    # copies of a key count together, as in one document
    assert {(r["id"], r["term"]): r["count"] for r in found.collect()}[1, "a b c d e"] == 9


def test_text_space_writes_rows_once(spark, monkeypatch):
    tags = []
    kept = lsa.materialize
    monkeypatch.setattr(lsa, "materialize", lambda df, tag: (tags.append(tag), kept(df, tag))[1])
    rows = [(k, f"t{(k * j) % 7}") for k in range(1, 30) for j in range(1, 6)]
    w = lsa.tfidf(spark.createDataFrame(rows, "id long, term string"), "id")
    assert tags == ["tf"]
    vec, _ = lsa.fit_lsa(w, "id", max_components=2)
    assert "text-rows" in tags  # the solver's steps read finished rows
    assert vec.count() == 29
