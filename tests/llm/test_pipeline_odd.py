"""The pipeline and its stages over awkward tables."""

from collections import Counter

import pytest

import corpus_pipeline
from litsieve.llm import toxicity

from .corpus import ODD, documents, empty

ITEM = "one two three four five six seven eight nine ten eleven twelve"
TOXIC = "zorkum quazzle vixtra"


def folder(spark, tmp_path, docs, labels, items):
    for name, df in (
        ("documents", docs),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(items, "item_id string, text string")),
    ):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    rows = [*ODD, (None, None), (None, "no id"), (50, f"so {ITEM} and on"), (51, "write to ann@example.org now"), (52, "a b c d e f g h"), (53, "a b c d e f g h")]
    rows += [(1000 + i, f"{TOXIC} number {i} w{i} v{i}") for i in range(40)] + [(2000 + i, f"calm plain words number {i} w{i * 7} v{i * 3}") for i in range(80)]
    labels = [(1000 + i, 0, 1) for i in range(40)] + [(2000 + i, 1, 0) for i in range(80)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0)]
    sf = folder(spark, tmp_path, documents(spark, rows), labels, [("i0", ITEM), ("i1", None), (None, ""), ("i2", ITEM)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept.append((name, docs.columns, Counter((r.doc_id, r.text) for r in docs.collect())))
    assert all(columns == kept[0][1] for _, columns, _ in kept)
    clean, single, free, safe = (c for _, _, c in kept)
    assert sum(1 for i, _ in clean if i is not None and 1000 <= i < 1040) <= 2 and sum(1 for i, _ in clean if i is not None and i >= 2000) >= 78
    ids = {i for i, _ in single}
    assert 52 in ids and 53 not in ids and 5 in ids and 8 not in ids and 2 in ids and 3 in ids and None in ids
    assert 50 in ids and 50 not in {i for i, _ in free} and len(single) - len(free) == 1
    assert [t for i, t in safe if i == 51] == ["write to [EMAIL] now"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {i for i, _ in safe}
    assert max(r.length for r in out) <= 1024


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 0)]])
def test_empty_tables(spark, tmp_path, labels):
    sf = folder(spark, tmp_path, empty(spark), labels, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_rows_without_labels_and_benchmark_stay(spark, tmp_path):
    sf = folder(spark, tmp_path, documents(spark, [(1, "alpha beta"), (2, None), (None, "gamma")]), [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {1, 2, None}


def test_keep_clean_passes_columns_and_nulls(spark):
    docs = documents(spark, [(1, None), (None, ""), (3, "calm words"), (3, "calm words")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.keep_clean(empty(spark), model).count() == 0
