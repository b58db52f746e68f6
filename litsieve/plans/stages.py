"""The screening process, stage by stage, as a person runs it: ``python -m litsieve.plans.stages STAGE CONFIG``.

State is versioned Parquet below ``state_path``; between stages a person edits review files. Each function takes the
session and the settings, reads the newest state and writes the next, so any stage can be repeated.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve import schema
from litsieve.config import Config, as_list
from litsieve.functions import search, text
from litsieve.operators import boilerplate, cluster, decisions, dedup, enrich, lsa, neardup, quality, relevance
from litsieve.functions.vectors import mean_vector
from litsieve.sources import tables
from litsieve.sources.lookup import Transport, http
from litsieve.storage import materialize

STAGES: dict[str, Callable[[SparkSession, Config], None]] = {}


def stage(f):
    STAGES[f.__name__] = f
    return f


def _path(c: Config, key: str, default: str) -> str:
    return c.paths.get(key, default)


def _state(c: Config) -> str:
    return _path(c, "state_path", "data/state")


def _read_review(spark: SparkSession, c: Config, key: str, default: str) -> DataFrame | None:
    path = _path(c, key, default)
    return tables.read_csv(spark, path).withColumn("orig_index", F.col("orig_index").cast("long")) if tables.exists(spark, path) else None


@stage
def initialize(spark: SparkSession, c: Config, transport: Transport = http) -> None:
    """Import, hollow flags, standard text, exact DOI copies, DOI recovery."""
    a = tables.read_search_results(spark, _path(c, "search_results_path", "data/search_results.csv"))
    a = quality.flag_hollow(a, "abstract", c.hollow_quantile, text.stopwords(c.languages, c.custom_stopwords))
    a = a.withColumn("abstract", F.trim(text.clean_abstract(F.col("abstract"), c.markdown)))
    a, terms = boilerplate.remove_repeated(a, "orig_index", "abstract", size=c.std_txt_window_size, over=c.std_txt_rep_thresh, ignore=as_list(c.ignore_std_txt_str))
    tables.write_review(terms, _path(c, "term_removal_log_path", "data/term_removal_log"), overwrite=True)
    a, log = dedup.remove_duplicate_dois(a, schema.empty_log(spark), "import")
    a = enrich.recover_dois(quality.doi_recovery_flag(a), transport, c.title_match_threshold, c.author_match_threshold, c.paths.get("answers_path"))
    tables.save_version(a, log, _state(c), "initialize")
    tables.write_review(quality.doi_manual_list(tables.load_version(spark, _state(c))[0]), _path(c, "doi_manual_csv", "data/doi_manual"), overwrite=True)


@stage
def data_retrieval(spark: SparkSession, c: Config, transport: Transport = http) -> None:
    """Manual DOI decisions, DOI copies again, missing fields from the services."""
    a, log = tables.load_version(spark, _state(c))
    d = _read_review(spark, c, "doi_manual_csv", "data/doi_manual")
    if d is not None:
        a, log = decisions.apply_manual(a, log, d, ["title", "authors", "journal", "year", "abstract", "doi"])
    a, log = dedup.remove_duplicate_dois(a, log, "data retrieval")
    a = enrich.retrieve_missing(a, transport, c.paths.get("answers_path"))
    tables.save_version(a, log, _state(c), "retrieval")
    a, _ = tables.load_version(spark, _state(c))
    tables.write_review(a.where("data_ret_flag = 'manual'").select("orig_index", "title", "abstract", "authors", "year", "keywords", "data_ret_flag", "doi", "hollow_flag", F.lit("").alias("update_flag")), _path(c, "manual_retrieval_csv", "data/manual_retrieval"), overwrite=True)


@stage
def duplicate_review(spark: SparkSession, c: Config) -> None:
    """Near-duplicate groups over active and removed rows, scored for review."""
    a, log = tables.load_version(spark, _state(c))
    d = _read_review(spark, c, "manual_retrieval_csv", "data/manual_retrieval")
    if d is not None:
        a, log = decisions.apply_manual(a, log, d, ["title", "abstract", "authors", "year", "keywords", "doi"])
        tables.save_version(a, log, _state(c), "manual")
        a, log = tables.load_version(spark, _state(c))
    both = decisions.combined_view(a, log).withColumn("combined", text.combined("year", "title", "abstract", "authors"))
    groups = neardup.near_duplicates(both, "orig_index", "combined", c.lsh_thresh).withColumnRenamed("component", "group_id")
    scored = neardup.score_groups(both, groups, "orig_index", "combined", c.split_threshold, c.length_threshold, c.agglomerative_distance)
    tables.write_review(neardup.review_table(both.drop("combined"), scored), _path(c, "duplicates_review_csv", "data/duplicates_review"), overwrite=True)


@stage
def duplicate_resolution(spark: SparkSession, c: Config) -> None:
    """R, K and M decisions of the duplicates review; the action log."""
    a, log = tables.load_version(spark, _state(c))
    d = _read_review(spark, c, "duplicates_review_csv", "data/duplicates_review")
    if d is None:
        raise FileNotFoundError(_path(c, "duplicates_review_csv", "data/duplicates_review"))
    a, log, actions = decisions.apply_duplicate_decisions(a, log, d)
    m = d.where("upper(trim(update_flag)) = 'M'").select("orig_index", "group_id", F.col("group_mean_sim").cast("double").alias("group_mean_sim"))
    a, log = dedup.resolve_merges(a, log, m, c.quick_data_merge_threshold)
    tables.write_actions(actions, _path(c, "actions_log_base_json", "data/actions_log"))
    tables.save_version(a, log, _state(c), "resolution")


@stage
def final_qc(spark: SparkSession, c: Config) -> None:
    """Final decisions, hollow and grey rows removed, quality flags."""
    a, log = tables.load_version(spark, _state(c))
    d = _read_review(spark, c, "duplicates_review_csv", "data/duplicates_review")
    if d is not None:
        a, log = decisions.apply_final(a, log, d)
    for flag, reason in (("hollow_flag", "Hollow Abstract"), ("grey_flag", "Grey Literature")):
        if flag in a.columns:
            a, log = quality.remove_flagged(a, log, flag, reason, "Final QC")
    a = quality.quality_checks(a, c.min_length, c.year_min, c.year_max, tuple(as_list(c.languages)))
    tables.save_version(a, log, _state(c), "qc")


@stage
def preprocess_abstracts(spark: SparkSession, c: Config) -> None:
    """Tokens, TF-IDF and the reduced text space."""
    a, _ = tables.load_version(spark, _state(c))
    a, _ = dedup.keep_first(a, "title")
    stop = text.stopwords(c.languages, c.custom_stopwords)
    doc = a.select("orig_index", text.content_tokens(text.document("abstract", "title", "keywords", "authors", "journal"), stop, text.words).alias("toks"))
    toks = doc.select("orig_index", F.explode(text.ngrams(F.col("toks"), *c.ngrams)).alias("term"))
    n = a.count()
    w = lsa.tfidf(toks, "orig_index", max_df=c.max_doc_freq, min_df=max(1, int(0.015 * n)), n_docs=n)
    vec, model = lsa.fit_lsa(w, "orig_index", max_components=c.max_svd_components, min_ratio=c.explained_variance)
    root = _path(c, "preprocess_pickle", "data/text_space")
    mode = "overwrite" if c.overwrite else "errorifexists"
    vec.write.mode(mode).parquet(f"{root}/vectors")
    spark.createDataFrame([(t, model.components[:, i].tolist()) for i, t in enumerate(model.vocabulary)], "term string, c array<double>").write.mode(mode).parquet(f"{root}/terms")


def _space(spark: SparkSession, c: Config) -> tuple[DataFrame, lsa.Lsa]:
    import numpy as np

    root = _path(c, "preprocess_pickle", "data/text_space")
    terms = spark.read.parquet(f"{root}/terms").orderBy("term").collect()  # the vocabulary, bounded in the fit
    return spark.read.parquet(f"{root}/vectors"), lsa.Lsa([r[0] for r in terms], np.array([r[1] for r in terms]).T, np.zeros(0))


@stage
def cluster_graph(spark: SparkSession, c: Config) -> None:
    """Ensemble labels, edit-distance graph, threshold search, rescue of single rows."""
    vec, _ = _space(spark, c)
    _, x = cluster.sample_matrix(vec, "orig_index", "vector")
    n = vec.count()
    k = cluster.choose_k(x, n)
    runs = c.num_groupings_small if n < 500 else c.num_groupings_large
    limit, pairs, members = cluster.ensemble_graph(vec, "orig_index", "vector", k, runs, c.ensemble_keep, c.ensemble_noise, c.grid_step, c.eps_factor)
    graph = cluster.graph_clusters(vec.select("orig_index"), pairs.unionByName(cluster.class_edges(members, "orig_index")), "orig_index", limit)
    placed = cluster.reassign_solos(vec.join(graph, "orig_index"), "vector", "orig_index")
    root = _path(c, "clusters_pickle", "data/clusters")
    placed.write.mode("overwrite" if c.overwrite else "errorifexists").parquet(f"{root}/members")
    pairs.where(F.col("dist") < limit).write.mode("overwrite" if c.overwrite else "errorifexists").parquet(f"{root}/edges")
    a, _ = tables.load_version(spark, _state(c))
    named = a.join(spark.read.parquet(f"{root}/members").select("orig_index", "cluster"), "orig_index")
    tables.write_review(named, _path(c, "clustered_data_txt", "data/clustered"), "\t", True, ("cluster", "orig_index"))
    tables.write_titles(named, f"{root}/titles", overwrite=c.overwrite)


def _clustered(spark: SparkSession, c: Config) -> DataFrame:
    members = spark.read.parquet(f"{_path(c, 'clusters_pickle', 'data/clusters')}/members")
    a, _ = tables.load_version(spark, _state(c))
    return members.join(a, "orig_index")


@stage
def define_clusters(spark: SparkSession, c: Config) -> None:
    """Coherence, selection and merging, terms and exemplars, the review file."""
    m = _clustered(spark, c).where(F.col("cluster") != cluster.SOLO)
    edges = spark.read.parquet(f"{_path(c, 'clusters_pickle', 'data/clusters')}/edges")
    stats = m.groupBy("cluster").agg(F.count("*").alias("size")).join(cluster.cluster_ess(m, "vector"), "cluster").join(cluster.cluster_silhouette(m, "orig_index", "vector"), "cluster").join(cluster.mean_clustering(edges, m.select("orig_index", "cluster"), "orig_index"), "cluster")
    scores = materialize(cluster.coherence(stats).select("cluster", F.col("coherence").alias("score")), "scores")
    info = m.groupBy("cluster").agg(F.collect_list("title").alias("titles"), F.collect_list("orig_index").alias("members")).join(mean_vector(m, "cluster", "vector").select("cluster", "centroid"), "cluster")
    chosen = materialize(cluster.select_clusters(materialize(info, "info"), scores, cuts=c.elbow_cuts, percentile=c.merge_percentile / 100), "chosen")
    _, model = _space(spark, c)
    terms = lsa.infrequent_terms(materialize(lsa.cluster_terms(chosen, model), "terms"))
    best = cluster.exemplars(m.withColumn("cluster", F.col("cluster").cast("string")), "orig_index", "vector").select("cluster", F.col("exemplar").cast("string").alias("exemplar"))
    tables.write_review(tables.cluster_review(chosen, terms, best), _path(c, "text_review_clusters_csv", "data/text_review_clusters"), overwrite=True)
    chosen.write.mode("overwrite").parquet(f"{_path(c, 'clusters_pickle', 'data/clusters')}/chosen")


@stage
def train_article_group(spark: SparkSession, c: Config) -> None:
    """Labels from judged clusters, classifiers, blended scores, categories and prefilled judgments."""
    from pyspark.ml.functions import array_to_vector

    m = _clustered(spark, c)
    review = tables.read_csv(spark, _path(c, "text_review_clusters_csv", "data/text_review_clusters"))
    lab = relevance.label_articles(m, relevance.user_clusters(review))
    cents = mean_vector(m, "cluster", "vector")
    coh = review.select(F.explode(text.cluster_members(F.col("cluster_id"))).alias("cluster"), F.expr("try_cast(Coherence as double)").alias("coherence"))
    f = relevance.features(lab, cents, coh.withColumn("cluster", F.col("cluster").cast("int")), "vector", "orig_index")
    f = f.withColumn("features", array_to_vector(F.concat("vector", F.array("distance_to_centroid", "coherence_weight", "similarity_to_relevant"))))
    f = materialize(f, "features")
    preds, metrics = relevance.cross_validate(f, "orig_index", k=c.folds, seed=c.seed)
    blended = materialize(relevance.blend(preds, metrics, "orig_index"), "blended")
    bad = cents.join(lab.where("label = 'irrelevant'").select("cluster").distinct(), "cluster", "left_semi")
    near = materialize(cluster.assign_nearest(m.select("orig_index", "vector"), bad, "vector"), "nearest")
    near = near.join(coh.select(F.col("cluster").cast("int").alias("nearest"), "coherence"), "nearest", "left").select("orig_index", F.col("similarity").alias("irrelevant_similarity"), F.coalesce("coherence", F.lit(0.0)).alias("irrelevant_coherence"))
    scored = materialize(relevance.final_scores(blended.join(near, "orig_index", "left")), "final-scores")
    scored = relevance.categorise(scored, relevance.score_limits(scored))
    full = relevance.with_predictions(lab.drop("vector"), scored, "orig_index")
    query = ""
    if c.use_search_query:
        with open(_path(c, "search_query_file", "search_query.txt"), encoding="utf-8") as fh:
            query = fh.read()
    hit = search.matches(text.combined("title", "journal", "abstract", "keywords"), query) if query else F.lit(False)
    tables.write_review(relevance.prefill(full, hit), _path(c, "categorized_data_file", "data/categorized"), overwrite=True, order=("orig_index",))


@stage
def process_user_categorizations(spark: SparkSession, c: Config) -> None:
    """K and D judgments: kept rows become the next state, dropped ones are logged."""
    judged = tables.read_judged(spark, _path(c, "categorized_data_file", "data/categorized")).withColumn("orig_index", F.col("orig_index").cast("long"))
    _, log = tables.load_version(spark, _state(c))
    kept, log = quality.split_judgments(judged, log, c.reset_for_pipeline)
    tables.save_version(kept, log, _state(c), "judged")


def main(argv: list[str]) -> None:
    if len(argv) != 2 or argv[0] not in STAGES:
        sys.exit(f"usage: python -m litsieve.plans.stages STAGE CONFIG\nstages: {', '.join(STAGES)}")
    spark = SparkSession.builder.appName(argv[0]).getOrCreate()
    STAGES[argv[0]](spark, Config.load(argv[1]))


if __name__ == "__main__":
    main(sys.argv[1:])
