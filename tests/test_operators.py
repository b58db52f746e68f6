"""Small cases of the operators, by survey id."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from litsieve import schema
from litsieve.config import Config, parse_lines
from litsieve.functions import fuzzy, html, search, text, vectors
from litsieve.operators import boilerplate, cluster, decisions, dedup, enrich, lsa, neardup, quality, relevance
from litsieve.operators.graph import connected_components, local_clustering
from litsieve.sources import lookup, tables
from litsieve.storage import fresh_dir
from litsieve.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (text.strip_copyright, "ok text (C) 2019 foo\nnext", "ok text \nnext"),
        (text.strip_copyright, "a (c) x Press ltd", "a "),
        (text.strip_copyright, "d (psycinfo database record (c) 2012", "d "),
        (text.remove_punctuation, "a.b, c-d 3.5 end.", "ab  c-d 3.5 end."),
        (text.remove_punctuation, "p. 5 to 6. q", "p 5 to 6. q"),
        (text.remove_punctuation, "café (x)", "caf  x "),
        (text.remove_numbers, "1 2 3 a", " 2 a"),
        (text.remove_numbers, "a 12 b", "a b"),
        (text.remove_numbers, "a12 b 3", "a12 b "),
        (text.strip_markdown, "**a** __b__ *c* _d_ [t](u)", "a b c d t"),
        (text.strip_headers, "background: x. aims/hypothesis y", " x.  y"),
        (text.clean_column, "The cat; the CAT sat 5 times", "the cat sat times"),
        (text.fold_ascii, "a\tb‐c\né", "a b c"),
        (text.format_citation_authors, "Smith, John 0000-0001-2345-6789; doe jane; Plato", "Smith, J; doe, J; Plato"),
        (text.lemma, "studies", "study"),
        (text.lemma, "boxes", "box"),
        (text.lemma, "children", "child"),
        (text.lemma, "analysis", "analysis"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, given, f) == want


def test_windows_ngrams_and_removal(spark):
    assert one(spark, "a b c", lambda c: text.windows(c, 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: text.windows(c, 2)) == []
    assert one(spark, "a b 1", lambda c: text.ngrams(text.tokens(c), 1, 2)) == ["a", "b", "a b"]
    body = " ".join(["a b c d e"] * 6)
    df = spark.createDataFrame([(1, body), (2, "x"), (3, None)], "id long, t string")
    cleaned, log = boilerplate.remove_repeated(df, "id", "t")
    assert [tuple(r) for r in log.collect()] == [("a b c d e", 6)]
    assert {r.id: r.t for r in cleaned.collect()} == {1: " " * 5, 2: "x", 3: None}


def test_search_query():
    assert search.parse('"gambling task" or drug AND addict* OR opio*') == [["gambling task", "drug"], ["addict*", "opio*"]]
    assert search.parse("") == []


def test_fuzzy(spark):
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100 and fuzzy.partial_ratio("", "") == 100 and fuzzy.partial_ratio("a", "") == 0
    df = spark.createDataFrame([("abcd", "abxd"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.normalised_levenshtein(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0]
    df = spark.createDataFrame([("Deep Learning", "deep learning: a survey", "Smith, J; Doe, K", "Smith, John; Doe, Kim")], "a string, b string, c string, d string")
    assert tuple(df.select(fuzzy.title_matches(F.col("a"), F.col("b")), fuzzy.authors_match(F.col("c"), F.col("d"))).first()) == (True, True)


def test_html():
    assert html.text_of("<p>a &amp; b</p><script>x</script><!-- c --><b>d</b>") == "a & b d"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = df.select(vectors.cosine(a, b), vectors.euclidean(a, b), vectors.l2_normalise(a), vectors.l2_normalise(z), vectors.cosine(a, z), vectors.jensen_shannon(vectors.l1_normalise(a), vectors.l1_normalise(a)), vectors.hellinger(vectors.l1_normalise(a), vectors.l1_normalise(b))).first()
    assert r[0] == pytest.approx(0.96) and r[1] == pytest.approx(2**0.5) and r[2] == [0.6, 0.8] and r[3] == [0.0, 0.0] and r[4] is None and r[5] == 0
    assert r[6] == pytest.approx(np.sqrt(((np.sqrt([3 / 7, 4 / 7]) - np.sqrt([4 / 7, 3 / 7])) ** 2).sum() / 2))


ART = "orig_index long, title string, authors string, year string, abstract string, doi string, journal string, keywords string"


def arts(spark, rows):
    return spark.createDataFrame(rows, ART)


def test_dedup_keeps_every_row_once(spark):
    a = arts(spark, [(0, "a", "x", "2001", "t", "d", "j", "k"), (1, "b", "x", "2001", "t", "", "j", "k"), (2, "c", "x", "2001", "t", "d", "j", "k"), (3, "d", "x", "2001", "t", None, "j", "k")])
    kept, log = dedup.remove_duplicate_dois(a, a.limit(0), "s")
    assert sorted(r.orig_index for r in kept.collect()) == [0, 1, 3]
    assert [(r.orig_index, r.dup_doi_cnt) for r in log.collect()] == [(2, 2)]
    again, gone = dedup.keep_first(kept, "doi")
    assert gone.count() == 0 and again.count() == 3


def test_group_merges(spark):
    a = arts(spark, [(0, "t", "A;b", "2012", "short", "10.1/x", "jj", "b; A"), (1, "u", "b", "2010", "longer text", "", "j", "a;c"), (2, "v", "z", "1999", "q", "", "j", ""), (3, "w", "z", "1999", "q", "", "j", "")])
    m = spark.createDataFrame([(0, 7, 0.8), (1, 7, 0.8), (2, 8, 0.99), (3, 8, 0.99)], "orig_index long, group_id long, group_mean_sim double")
    active, log = dedup.resolve_merges(a, a.limit(0), m)
    rows = {r.orig_index: r for r in active.collect()}
    assert set(rows) == {2, 4}
    r = rows[4]
    assert (r.keywords, r.authors, r.year, r.doi, r.journal, r.abstract) == ("a; b; c", "a; b", "2010", "10.1/x", "jj", "longer text")
    assert r.merged and r.flag_years and r.flag_dois and sorted(x.orig_index for x in log.collect()) == [0, 1, 3]


def test_flags_and_checks(spark):
    df = spark.createDataFrame([(i, " ".join(["word"] * n)) for i, n in enumerate((1, 2, 3, 10))], "orig_index long, abstract string")
    assert [r.hollow_flag for r in quality.flag_hollow(df).orderBy("orig_index").collect()] == [True, False, False, False]
    a = arts(spark, [(0, "a", "x", "2001", "t", "", "j", "k"), (1, "", "x", "", "t", "", "j", "k"), (2, "a", "", "2001", "", "d", "j", "k")])
    f = quality.missing_data_flag(quality.doi_recovery_flag(a)).orderBy("orig_index").collect()
    assert [(r.doi_recovery_flag, r.data_ret_flag) for r in f] == [("auto", ""), ("manual", "manual"), ("", "auto")]
    q = quality.quality_checks(a.withColumn("language", F.lit("Latin")), 1).orderBy("orig_index").collect()
    assert [(r.year_check, r.language_check, r.doi_check, r.abstract_check, r.needs_review) for r in q] == [(False, True, True, True, True), (True, True, True, True, True), (False, True, False, True, True)]


def test_decisions(spark):
    a = arts(spark, [(i, f"t{i}", "x", "2001", "t", "d", "j", "k") for i in range(4)])
    d = spark.createDataFrame([(0, "u", "new", ""), (1, "R", "", ""), (2, "g", "", "d9")], "orig_index long, update_flag string, title string, doi string")
    active, log = decisions.apply_manual(a, a.limit(0), d, ["title", "doi"])
    rows = {r.orig_index: (r.title, r.doi, r.grey_flag) for r in active.collect()}
    assert rows == {0: ("new", "d", False), 2: ("t2", "d9", True), 3: ("t3", "d", False)}
    assert [(r.orig_index, r.reason_for_removal) for r in log.collect()] == [(1, "REVIEW")]
    d = spark.createDataFrame([(0, "R", "dup"), (1, "K", ""), (3, "R", "zzz")], "orig_index long, update_flag string, flag_note string")
    active, log, actions = decisions.apply_duplicate_decisions(active, log, d)
    assert sorted(r.orig_index for r in active.collect()) == [1, 2]
    assert {r.orig_index: r.reason_for_removal for r in log.collect()} == {0: "Duplicate", 3: "Unknown reason"}
    assert {tuple(r) for r in actions.collect()} == {("removed", 0), ("kept", 1), ("removed", 3)}
    assert decisions.apply_final(active, log, a)[0] is active
    fin = a.where("orig_index = 2").withColumn("Decision", F.lit("a")).withColumn("title", F.lit("again")).unionByName(a.where("orig_index = 1").withColumn("Decision", F.lit("R")))
    active, log = decisions.apply_final(active, log, fin)
    assert [(r.orig_index, r.title) for r in active.collect()] == [(2, "again")] and log.count() == 3


def test_judgments(spark):
    j = spark.createDataFrame([(1, "k"), (2, "D"), (3, "")], "orig_index long, user_judgment string")
    kept, log = quality.split_judgments(j, j.limit(0), True)
    assert [tuple(r) for r in kept.collect()] == [(1,)] and [r.reason_for_removal for r in log.collect()] == ["Irrelevant"]


def test_components_and_clustering(spark):
    e = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (9, 8), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(60)], "src long, dst long")
    c = {r.node: r.component for r in connected_components(e).collect()}
    assert {c[k] for k in (1, 2, 3, 4)} == {1} and c[9] == 8 and {c[k] for k in range(100, 161)} == {100}
    t = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (2, 1)], "src long, dst long")
    assert {r.node: round(r.clustering, 3) for r in local_clustering(t).collect()} == {1: 1.0, 2: 1.0, 3: 0.333, 4: 0.0}


def test_neardup_review(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma delta epsilon zeta eta theta iota lambda"), (3, "quite another thing here"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, None)], "orig_index long, abstract string")
    j = sorted(tuple(r) for r in neardup.jaccard_join(df, "orig_index", "abstract", 0.8).collect())
    assert j == [(1, 2, pytest.approx(9 / 11)), (1, 4, 1.0)]  # a copy is a pair with its class's first row
    near = neardup.near_duplicates(df, "orig_index", "abstract", 0.8)
    comp = {r.orig_index: r.component for r in near.collect()}
    assert comp.get(1) == comp.get(4) == 1
    groups = spark.createDataFrame([(1, 0), (2, 0), (4, 0)], "orig_index long, group_id long")
    s = neardup.score_groups(df, groups, "orig_index", "abstract", split_below=0.5)
    assert s.count() == 3 and neardup.review_table(df, s).count() == 3
    split = neardup.score_groups(df, spark.createDataFrame([(1, 0), (3, 0), (4, 0)], "orig_index long, group_id long"), "orig_index", "abstract")
    assert [(r.a, r.b) for r in split.collect()] == [(1, 4)]
    said = {r.id: r.art_to_art_group_sim for r in neardup.similarity_strings(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "a long, b long, similarity double")).collect()}
    assert said[1] == "doc_3: 0.90; doc_2: 0.50"
    assert neardup.complete_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]])).tolist() == [0, 0, 1]


def test_small_kernels():
    assert cluster.adaptive_percentile(211, 20, 1000) == pytest.approx(2.93265, abs=1e-4)
    assert cluster.adaptive_percentile(1000, 27, 50) == pytest.approx(2.98899, abs=1e-4)
    assert cluster.assignment_quantile(211) == pytest.approx(0.215120, abs=1e-5)
    assert cluster.myround(12) == 10 and cluster.myround(13) == 15
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    truth = np.repeat([0, 1, 2], 30)
    for label in (cluster.kmeans(x, 3, 1)[0], cluster.agglomerate(x, 3), cluster.agglomerate(x, 3, "complete"), cluster.dbscan(x, 1.0, 3), cluster.spectral(x)[1]):
        assert cluster.adjusted_rand(truth, label) == pytest.approx(1.0)
    assert cluster.silhouette(x, truth) > 0.9 and cluster.calinski_harabasz(x, truth) > 1000
    assert cluster.scan_k(x, 2, 8, 1, "bic") == 3 and cluster.scan_k(x, 2, 8, 1, "sil") == 3 and cluster.k_consensus(x) == 3
    assert cluster.choose_k(x) >= np.log2(90) * np.e - 1
    assert cluster.knee([1, 2, 3, 4, 5], [0, 8, 9, 9.5, 10]) == 2 and cluster.knee([1, 2, 3], [1, 1, 1]) is None
    f = cluster.parafac(np.einsum("i,j,k->ijk", [1.0, 2], [1.0, 3, 2], [2.0, 1, 1]), 1)
    assert np.einsum("ir,jr,kr->ijk", *f)[1, 1, 0] == pytest.approx(12, rel=1e-3)
    with pytest.raises(ValueError):
        cluster.scan_k(x, 2, 3, metric="x")


def test_cluster_operators(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (np.eye(4)[i % 3] + rng.normal(0, 0.05, 4)).tolist(), f"title {i}") for i in range(36)] + [(99, cluster.SOLO, [1.0, 0.05, 0.0, 0.0], "solo")]
    df = spark.createDataFrame(rows, "id long, cluster int, v array<double>, title string")
    moved = {r.id: r.cluster for r in cluster.reassign_solos(df, "v", "id").collect()}
    assert moved[99] in (0, cluster.SOLO)
    own = df.where("id < 99")
    labels = cluster.ensemble(own, "id", "v", 3, runs=4)
    assert labels.count() == 36 and len(labels.first()["labels"]) == 12
    pairs = cluster.edit_distances(labels, "id", "labels").cache()
    g = {r.id: r.cluster for r in cluster.graph_clusters(own.select("id"), pairs, "id", 0.5).collect()}
    assert len(set(g.values())) <= 6 and cluster.search_threshold(pairs, 36, 0.4, 3.0) > 0
    info = own.groupBy("cluster").agg(F.collect_list("title").alias("titles"), F.collect_list("id").alias("members")).join(vectors.mean_vector(own, "cluster", "v").select("cluster", "centroid"), "cluster")
    scores = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.3)], "cluster int, score double")
    assert [r.above for r in cluster.gap_cut(scores).orderBy(F.desc("score")).collect()] == [True, True, False]
    assert cluster.select_clusters(info, scores).count() >= 2
    assert cluster.merged_clusters(info, [(0, 1)], scores).first()["cluster"] == "merged_0_1"
    terms = spark.createDataFrame([("drug", 0, 1), ("drug use", 0, 2), ("brain", 0, 3)], "term string, cluster int, rank int")
    assert sorted(r.term for r in lsa.drop_contained(terms, "cluster").collect()) == ["brain", "drug use"]
    assert lsa.infrequent_terms(terms, k=2).count() == 2
    ex = cluster.exemplars(own, "id", "v")
    assert tables.cluster_report(info, terms, ex.withColumn("exemplar", F.col("exemplar").cast("string")), "cluster").count() == 3
    assert tables.cluster_review(info.join(scores, "cluster"), terms, ex, "cluster").count() == 3
    assert tables.titles_report(df).collect()[-1][0].startswith("solo")


def test_lsa(spark):
    docs = ["red apple pie", "green apple pie", "fast blue car", "slow blue car", "old red car"]
    toks = spark.createDataFrame([(i, t) for i, d in enumerate(docs) for t in d.split()], "id long, term string")
    w = lsa.tfidf(toks, "id")
    vec, model = lsa.fit_lsa(w, "id", max_components=3)
    rows = {r.id: np.array(r.vector) for r in vec.collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in rows.values()) and rows[0] @ rows[1] > rows[0] @ rows[2]
    assert (np.diff(model.ratios) <= 1).all() and lsa.top_concepts(vec, "id", "vector", 2).count() <= 10
    cents = vectors.mean_vector(vec.withColumn("cluster", (F.col("id") > 1).cast("int")), "cluster", "vector")
    assert lsa.cluster_terms(cents, model, k=3).count() >= 2


def test_relevance(spark):
    review = spark.createDataFrame([("merged_1_2", "r"), ("3", "I"), ("4", "?")], "cluster_id string, user_judgment string")
    judged = relevance.user_clusters(review)
    assert {tuple(r) for r in judged.collect()} == {("1", "relevant"), ("2", "relevant"), ("3", "irrelevant")}
    a = spark.createDataFrame([(i, c, [float(c == 1), float(c == 3), 0.1]) for i, c in enumerate([1, 2, 3, 9])], "id long, cluster int, v array<double>")
    lab = relevance.label_articles(a, judged)
    assert {r.id: r.label for r in lab.collect()} == {0: "relevant", 1: "relevant", 2: "irrelevant", 3: "unknown"}
    cents = vectors.mean_vector(a, "cluster", "v")
    f = relevance.features(lab, cents, spark.createDataFrame([(1, 0.7)], "cluster int, coherence double"), "v", "id")
    assert {r.id: r.coherence_weight for r in f.collect()}[0] == 0.7 and f.count() == 4
    s = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, final_score double")
    c = relevance.categorise(s, relevance.score_limits(s))
    p = relevance.prefill(c.withColumn("t", F.lit("drug")), search.matches(F.col("t"), "drug"))
    assert {r.category for r in p.collect()} == {"Irrelevant", "Borderline", "Relevant"}
    assert {r.user_judgment for r in p.where("category = 'Irrelevant'").collect()} == {"K"}
    assert relevance.sample_by_category(c, "id", 2).count() <= 6


def test_sources(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(",".join(schema.RENAMES) + ',Extra\n"A ""q""",2001,J,,,,,"X; Y",English,"Two\nLINES",10.1/a,k,zz\nB,2002,J,,,,,,English,,,,\n', encoding="utf-8")
    a = tables.read_search_results(spark, str(path), ["title"])
    rows = a.orderBy("orig_index").collect()
    assert [(r.orig_index, r.title, r.abstract, r.orig_abstract) for r in rows] == [(0, 'A "q"', "two\nlines", "Two\nLINES"), (1, "B", "", "")]
    with pytest.raises(ValueError):
        schema.articles(a)
    root = str(tmp_path / "state")
    log = schema.empty_log(spark)
    tables.save_version(a, log, root)
    tables.save_version(a.limit(1), log, root, "qc")
    assert tables.load_version(spark, root)[0].count() == 1 and tables.load_version(spark, root, "v=00001")[0].count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load_version(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        tables.read_judged(spark, str(tmp_path / "none"))
    out = str(tmp_path / "review")
    tables.write_review(a, out)
    assert tables.read_judged(spark, out).count() == 2
    first, second = (tables.write_actions(spark.createDataFrame([("removed", 1)], "action string, article_id long"), str(tmp_path / "log")) for _ in range(2))
    assert second == first + "_1"


def test_config():
    c = Config.of(parse_lines(["overwrite: False", "", "markdown: true", "min_length: 5", "title_path: a:b", "ngram_range: 1, 3"]))
    assert not c.overwrite and c.markdown and c.min_length == 5 and c.paths["title_path"] == "a:b" and c.ngrams == (1, 3)
    with pytest.raises(ValueError):
        Config.of({"min_length": "x"})
    assert "al" in text.stopwords("english, spanish", "al, et") and text.stopwords("klingon") == text.stopwords("english")


CROSSREF = {"title": ["Deep Work"], "author": [{"given": "Jo A.", "family": "Smith"}, {"name": "Group"}], "published-print": {"date-parts": [[2002]]}, "page": "1-2", "abstract": "a much longer abstract than before", "DOI": "10.1/found", "subject": ["s1", "s2"], "container-title": ["J"]}


def answers(url):
    if "query.title" in url:
        return 200, json.dumps({"message": {"items": [{"title": ["Other"], "DOI": "10.1/no"}, CROSSREF]}})
    if "crossref" in url:
        return (200, json.dumps({"message": CROSSREF})) if "one" in url else (404, "")
    if "esearch" in url:
        return 200, json.dumps({"esearchresult": {"idlist": ["7"] if "two" in url else []}})
    if "efetch" in url:
        return 200, "<A><Journal><Title>PJ</Title><PubDate><Year>1999</Year></PubDate></Journal><ArticleTitle>P <i>t</i></ArticleTitle><AbstractText>one</AbstractText><AbstractText>two</AbstractText><LastName>Roe</LastName><Initials>R</Initials><Keyword>k1</Keyword></A>"
    if "opencitations" in url and "three" in url:
        return 200, json.dumps([{"title": "O", "author": "Roe, Ann 0000-0001", "year": "1998", "source_title": "OJ", "page": "3"}])
    return 404, ""


def test_enrichment(spark):
    a = arts(spark, [(0, "Deep work", "Smith, Jo A.; Group", "2001", "t", "", "j", "k"), (1, "Other", "Nobody", "1990", "t", "", "j", "k"), (2, "x", "y", "2000", "t", "10.1/z", "j", "k")])
    got = {r.orig_index: (r.doi, r.doi_recovery_flag) for r in enrich.recover_dois(quality.doi_recovery_flag(a), answers).collect()}
    assert got == {0: ("10.1/found", "auto"), 1: ("", "manual"), 2: ("10.1/z", "")}
    b = arts(spark, [(0, "", "", "", "short", "10.1/one", "", ""), (1, "", "", "", "", "10.1/two", "", ""), (2, "", "", "", "", "10.1/three", "", ""), (3, "", "", "", "", "", "", ""), (4, "t", "a", "2000", "x", "10.1/four", "", "")])
    r = {x.orig_index: x for x in enrich.retrieve_missing(b, answers).collect()}
    assert (r[0].title, r[0].authors, r[0].year, r[0].abstract, r[0].keywords, r[0].data_ret_flag) == ("Deep Work", "Smith, JA; Group", "2002", CROSSREF["abstract"], "s1; s2", "auto")
    assert (r[1].title, r[1].authors, r[1].year, r[1].abstract, r[1].data_ret_flag) == ("P  t", "Roe, R", "1999", "one two", "auto")
    assert (r[2].title, r[2].authors, r[2].data_ret_flag) == ("O", "Roe, A", "manual")
    assert r[3].data_ret_flag == "manual" and r[4].data_ret_flag == ""


def test_lookup_source(spark):
    spark.dataSource.register(lookup.BiblioSource)
    url = lookup.SERVICES["crossref_doi"].format(q="10.1%2Fa")
    df = spark.read.format("biblio").option("service", "crossref_doi").option("queries", "10.1/a\n10.1/b").option("fixture", json.dumps({url: "yes"})).load()
    assert {tuple(r) for r in df.collect()} == {("10.1/a", "yes"), ("10.1/b", None)}


def test_streams(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [Row(k="a", ts="2024-01-01 00:00:00"), Row(k="a", ts="2024-01-01 00:10:00"), Row(k="b", ts="2024-01-01 00:20:00")]
    spark.createDataFrame(rows).write.json(src)
    stream = spark.readStream.schema("k string, ts timestamp").json(src)
    q = ingest.dedup_stream(stream, "k", "ts").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]
    q = ingest.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r["count"]) for r in spark.table("wc").collect()} == {("a", 2), ("b", 1)}
    kept = []
    store = spark.createDataFrame([(1, "one two three four five")], "id long, t string")
    batch = spark.createDataFrame([(2, "one two three four five"), (3, "six seven eight nine"), (4, "six seven eight nine"), (5, "other")], "id long, t string")
    ingest.against_store(lambda: store, lambda df: kept.extend(r.id for r in df.collect()), "id", "t")(batch, 0)
    assert sorted(kept) == [3, 5]


def test_shared_dirs_are_fresh(spark):
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_repeated_decisions_count_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "orig_index long, title string")
    log = spark.createDataFrame([(9, "w", "r", "s", 1)], "orig_index long, title string, reason_for_removal string, removal_step string, dup_doi_cnt long")
    twice = spark.createDataFrame([(1, "one"), (1, "two"), (None, "n")], "orig_index long, title string").coalesce(1)
    assert sorted(tuple(r) for r in decisions.updated(a, twice, "orig_index", ["title"]).collect()) == [(1, "two"), (2, "y"), (3, "z")]
    d = spark.createDataFrame([(2, "K", "", 1), (2, "r", "dup", 2), (9, "K", "", 1), (9, "k", "", 2), (3, "R", "h", 1), (3, "K", "", 2)], "orig_index long, update_flag string, flag_note string, at long")
    act, new, done = decisions.apply_duplicate_decisions(a, log, d, order="at")
    assert sorted(r.orig_index for r in act.collect()) == [1, 3, 9]
    assert [(r.orig_index, r.reason_for_removal) for r in new.collect()] == [(2, "Duplicate")]
    assert sorted(tuple(r) for r in done.collect()) == [("kept", 3), ("kept", 9), ("removed", 2)]


def test_pubmed_references_and_authors(spark):
    from litsieve.operators.enrich import parse_pubmed

    xml = """<PubmedArticle><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J &amp; K</Title></Journal>
    <ArticleTitle>A &lt; B &amp;amp; <i>C</i> &#233;&#x41; &#38;lt;</ArticleTitle><AuthorList><Author><LastName>A</LastName></Author><Author><LastName>B</LastName><Initials>Q</Initials></Author>
    <Author><CollectiveName>The Group</CollectiveName></Author></AuthorList><Abstract><AbstractText Label="x">One.</AbstractText><AbstractText>Two &gt; 1.</AbstractText></Abstract></PubmedArticle>"""
    r = spark.createDataFrame([(xml,)], "x string").select(parse_pubmed(F.col("x")).alias("w")).first().w
    assert " ".join(r.title.split()) == "A < B &amp; C éA &lt;"
    assert (r.authors, r.year, r.journal, r.abstract) == ("A; B, Q; The Group", "2001", "J & K", "One. Two > 1.")


def test_versions_after_a_drop(spark, tmp_path):
    df, root = spark.range(1), str(tmp_path / "state")
    for _ in range(3):
        tables.save_version(df, df, root)
    tables.drop_version(spark, root, tables.steps(spark, root)[0])
    assert tables.save_version(df, df, root).endswith("v=00004") and len(tables.steps(spark, root)) == 3


def test_reload_tries_tabs_then_commas(spark, tmp_path):
    for name, sep in (("t", "\t"), ("c", ",")):
        (tmp_path / name).write_text(f"a{sep}b\n1{sep}2\n")
        assert tables.read_csv(spark, str(tmp_path / name), None).columns == ["a", "b"]


def test_merged_cluster_of_many_ids(spark):
    ids = [str(k) for k in range(1500)]
    got = spark.createDataFrame([("merged_" + "_".join(ids),), ("7",)], "c string").select(text.cluster_members(F.col("c")).alias("m")).collect()
    assert got[0].m == ids and got[1].m == ["7"]


def test_threshold_search_leaves_out_its_end_and_equal_rows(spark):
    import math

    edges = [(a, b, 0.0) for a in range(3) for b in range(a)] + [(10 + a, 10 + b, 0.1 + 0.01 * a) for a in range(12) for b in range(a)] + [(a, 10 + a, 1.0) for a in range(3)]
    pairs = spark.createDataFrame(edges, "a long, b long, dist double")
    own = [d for _, _, d in edges if d not in (0.0, 1.0)]
    r = float(np.quantile(own, 50 / (100 * math.e)))
    grid = np.arange(max(0.05, 0.3 - r), min(0.95, 0.3 + r / 3), 0.025)
    best, want = -math.inf, 0.3
    for t in grid:
        comp = {v: v for v in {x for e in edges for x in e[:2]}}
        find = lambda v: v if comp[v] == v else find(comp[v])  # noqa: B023, E731
        for a, b, d in edges:
            if d < t:
                comp[find(a)] = find(b)
        sizes = [n for n in np.unique([find(v) for v in comp], return_counts=True)[1] if n > 1]
        v = cluster.threshold_score(np.array(sizes, dtype=float), 15 - sum(sizes), 15)
        if v is not None and v > best:
            best, want = v, float(t)
    assert cluster.search_threshold(pairs, 15, 0.3, 50) == pytest.approx(want)


def test_ensemble_schedule_and_every_row(spark):
    assert cluster.schedule(0, 50, 10, 1.0) == (1.0, 2, "ward", 8)
    eps, core, link, k = cluster.schedule(26, 50, 10, 1.0)
    assert (core, link, k) == (3, "average", 10) and eps == pytest.approx(1.5)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.05, (1300, 3)) for c in (0.0, 3.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    got = cluster.ensemble(df, "id", "v", 2, runs=2, keep=1.0).collect()
    assert len(got) == 2600  # more than the fitted sample
    kinds = {tuple(r.labels[:1]) for r in got if r.id < 1300}, {tuple(r.labels[:1]) for r in got if r.id >= 1300}
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]


def test_agglomeration_by_chains_equals_greedy_merging():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (40, 3))
    for link in ("ward", "complete", "average", "single"):
        groups = [[i] for i in range(40)]
        d = lambda a, b: np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(-1))
        far = {
            "ward": lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(),
            "complete": lambda a, b: d(a, b).max(),
            "average": lambda a, b: d(a, b).mean(),
            "single": lambda a, b: d(a, b).min(),
        }[link]
        while len(groups) > 5:
            _, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            groups[i] += groups.pop(j)
        label = cluster.agglomerate(x, 5, link)
        assert sorted(map(sorted, groups)) == sorted(sorted(np.flatnonzero(label == v).tolist()) for v in set(label.tolist()))


def test_partial_ratio_by_plain_dynamic_programming():
    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for k, e in enumerate(b):
                new.append(row[k] + 1 if c == e else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        s, t = sorted((a, b), key=len)
        best = max(2 * lcs(s, w) / (len(s) + len(w)) for k in range(1 - len(s), len(t)) if (w := t[max(k, 0) : k + len(s)]))
        assert fuzzy.partial_ratio(a, b) == round(100 * best)
