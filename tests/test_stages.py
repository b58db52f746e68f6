"""The whole screening process on a small made-up export, with the reviewer's edits between the stages."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from litsieve import schema
from litsieve.config import Config
from litsieve.plans import stages
from litsieve.sources import tables

TOPICS = {
    "drug": "cocaine heroin craving addiction relapse dependence reward dopamine withdrawal abuse".split(),
    "model": "bayesian likelihood parameter estimation simulation inference posterior hierarchical fit recovery".split(),
    "plant": "leaf root soil nitrogen photosynthesis chlorophyll stem seed germination drought".split(),
}


def export(path, rng):
    rows = []
    for i in range(45):
        topic = list(TOPICS)[i % 3]
        words = [rng.choice(TOPICS[topic]) for _ in range(40)]
        rows.append([f"{topic} study number {i} {rng.choice(words)}", str(2000 + i % 20), f"Journal {topic}", "", "", "", "", f"Author{i}, A", "English", f"Background: {' '.join(words)}. (C) 2019 Press", f"10.1/{i}", topic])
    rows.append(rows[3][:])  # the same DOI
    near = rows[4][:]
    near[10], near[0] = "10.1/near", rows[4][0] + " again"
    rows.append(near)
    rows.append(["short", "2001", "J", "", "", "", "", "Z, Z", "English", "tiny", "10.1/tiny", ""])
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(schema.RENAMES)
        w.writerows(rows)
    return len(rows)


def edit(spark, path, change):
    df = tables.read_csv(spark, path).toPandas()
    change(df)
    tables.write_review(spark.createDataFrame(df.astype(object).where(df.notna(), None).astype(str).replace("None", "")), path, overwrite=True)


@pytest.mark.filterwarnings("ignore")
def test_every_stage_runs(spark, tmp_path):
    n = export(tmp_path / "in.csv", random.Random(7))
    names = ("doi_manual_csv", "manual_retrieval_csv", "duplicates_review_csv", "actions_log_base_json", "preprocess_pickle", "clusters_pickle", "clustered_data_txt", "text_review_clusters_csv", "categorized_data_file", "state_path", "term_removal_log_path")
    c = Config.of({k: str(tmp_path / k) for k in names} | {"search_results_path": str(tmp_path / "in.csv"), "overwrite": "true", "min_length": "5", "max_svd_components": "6", "ngram_range": "1,1", "num_groupings_small": "4", "max_doc_freq": "0.9", "use_search_query": "true", "search_query_file": str(tmp_path / "q.txt")})
    (tmp_path / "q.txt").write_text('addict* AND "cocaine"')
    none = lambda url: (404, "")
    stages.initialize(spark, c, none)
    a, log = tables.load_version(spark, c.paths["state_path"])
    assert a.count() == n - 1 and log.count() == 1 and a.where("hollow_flag").count() >= 1
    assert a.where("abstract like '%press%' or abstract like '%background:%'").count() == 0
    stages.data_retrieval(spark, c, none)
    stages.duplicate_review(spark, c)
    review = c.paths["duplicates_review_csv"]
    found = tables.read_csv(spark, review)
    assert {"10.1/4", "10.1/near"} <= {r.doi for r in found.collect()}

    def merge(df):
        df.loc[df.doi.isin(["10.1/4", "10.1/near"]), "update_flag"] = "M"

    edit(spark, review, merge)
    stages.duplicate_resolution(spark, c)
    a, log = tables.load_version(spark, c.paths["state_path"])
    assert a.where("doi = '10.1/near'").count() + a.where("doi = '10.1/4'").count() == 1
    stages.final_qc(spark, c)
    a, log = tables.load_version(spark, c.paths["state_path"])
    assert "needs_review" in a.columns and log.where("reason_for_removal = 'Hollow Abstract'").count() >= 1
    stages.preprocess_abstracts(spark, c)
    stages.cluster_graph(spark, c)
    stages.define_clusters(spark, c)
    judged = tables.read_csv(spark, c.paths["text_review_clusters_csv"])
    assert judged.count() >= 2
    ids = [r.cluster_id for r in judged.collect()]

    def judge(df):
        df["user_judgment"] = ["R" if k % 2 == 0 else "I" for k in range(len(df))]

    edit(spark, c.paths["text_review_clusters_csv"], judge)
    assert ids
    small = stages.relevance.cross_validate
    stages.relevance.cross_validate = lambda *x, **kw: small(*x, **kw | {"use": ["logistic_regression", "naive_bayes"], "k": 2})
    try:
        stages.train_article_group(spark, c)
    finally:
        stages.relevance.cross_validate = small
    out = tables.read_csv(spark, c.paths["categorized_data_file"])
    assert set(r[0] for r in out.select("user_judgment").distinct().collect()) <= {"K", "D"}
    stages.process_user_categorizations(spark, c)
    kept, log = tables.load_version(spark, c.paths["state_path"])
    assert kept.count() == out.where(F.col("user_judgment") == "K").count()
    assert log.where("reason_for_removal = 'Irrelevant'").count() == out.where(F.col("user_judgment") == "D").count()
