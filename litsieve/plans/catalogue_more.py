"""More registered queries: text, lists, parsers, decisions, scores and vectors against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from litsieve import schema
from litsieve.functions import text, vectors
from litsieve.operators import cluster, decisions, dedup, enrich, lsa, quality, relevance
from litsieve.plans.catalogue import ART, CENT, SPACED, STOP, _emb, articles, cleaned_sql, read_table, registered

# --- text ------------------------------------------------------------------------------------------------


def _sql(x: str) -> str:
    return x.replace("'", "''")


def _replaced(x: str, patterns: list[str], by: str, flags: str = "") -> str:
    return reduce(lambda acc, p: f"regexp_replace({acc}, '{flags}{_sql(p)}', '{by}', 'g')", patterns, x)


def _digest(c, name="digest"):
    return F.md5(c.cast("binary")).alias(name)


MARKED = "('**' || left(t, 20) || '** _x_ ![' || source || '](u) ' || t || ' [' || lang || '](v)')"


def _marked():
    return F.concat(F.lit("**"), F.substring("abstract", 1, 20), F.lit("** _x_ !["), F.col("source"), F.lit("](u) "), F.col("abstract"), F.lit(" ["), F.col("lang"), F.lit("](v)"))


@registered(f"WITH {ART} SELECT doc_id, md5({_replaced(MARKED, text.MARKDOWN, chr(92) + '1')}) AS digest FROM art")
def doc_strip_markdown(spark, d):
    """T2."""
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), _digest(text.strip_markdown(_marked())))


HEADED = "('background: ' || left(t, 40) || ' methods. ' || t || ' results: [abstract from author]')"


def _headed():
    return F.concat(F.lit("background: "), F.substring("abstract", 1, 40), F.lit(" methods. "), F.col("abstract"), F.lit(" results: [abstract from author]"))


@registered(f"WITH {ART} SELECT doc_id, md5({_replaced(HEADED, text.HEADERS, '')}) AS digest FROM art")
def doc_strip_headers(spark, d):
    """T3."""
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), _digest(text.strip_headers(_headed())))


TAGGED = f"('<p class=x>' || {HEADED} || '</p><style>s</style> (c) 2001 held by')"
TAGS = ["<script\\b.*?</script\\s*>", "<style\\b.*?</style\\s*>"]
UNTAGGED = f"regexp_replace(regexp_replace({_replaced(TAGGED, TAGS, ' ', '(?is)')}, '(?s)<!--.*?-->', ' ', 'g'), '<[^<>]*>', ' ', 'g')"


@registered(f"WITH {ART} SELECT doc_id, md5({_replaced(_replaced(UNTAGGED, text.HEADERS, ''), text.COPYRIGHT, '', '(?i)')}) AS digest FROM art")
def doc_clean_abstract(spark, d):
    """T5, T1, T3, T4 in turn."""
    c = F.concat(F.lit("<p class=x>"), _headed(), F.lit("</p><style>s</style> (c) 2001 held by"))
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), _digest(text.clean_abstract(c)))


@registered(f"WITH {ART} SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[\\n\\t‐]', ' ', 'g'), '[^\\x00-\\x7f]', '', 'g'), ' +', ' ', 'g'))) AS digest FROM art")
def doc_fold_ascii(spark, d):
    """T9."""
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), _digest(text.fold_ascii(F.col("abstract"))))


@registered(f"WITH {ART} SELECT doc_id, md5({cleaned_sql(chr(40) + 'lower(source || chr(32) || lang || chr(32) || t)' + chr(41))}) AS digest FROM art")
def doc_document(spark, d):
    """T11, T16."""
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), _digest(text.document("source", "lang", "abstract")))


LEMMA = (
    "CASE "
    + " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in text.IRREGULAR.items())
    + " WHEN regexp_matches(x, '(ss|us|is)$') OR length(x) < 4 THEN x WHEN regexp_matches(x, 'ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '(ches|shes|sses|xes|zes)$') THEN regexp_replace(x, 'es$', '') ELSE regexp_replace(x, 's$', '') END"
)
CONTENT = f"list_filter(list_transform(list_filter({SPACED}, lambda x: NOT list_contains([{STOP}], x)), lambda x: {LEMMA}), lambda x: length(x) > 1 AND NOT list_contains([{STOP}], x))"


@registered(f"WITH {ART}, w AS (SELECT doc_id, {CONTENT} AS w FROM art) SELECT doc_id, len(w)::BIGINT AS n, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM w")
def doc_content_tokens(spark, d):
    """T12 to T15."""
    w = text.content_tokens(F.col("abstract"), text.STOP_WORDS)
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), F.size(w).cast("long").alias("n"), _digest(F.array_join(w, " ")))


def _rules_sql(rules, c: str) -> str:
    quoted = [(p.replace("'", "''"), to.replace("$", "\\").replace("'", "''")) for p, to in rules]
    return reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}', 'g')", quoted, c)


TREEBANK = f"list_filter(string_split_regex({_rules_sql(text.CLOSING, f"concat(' ', {_rules_sql(text.OPENING, "coalesce(text, '')")}, ' ')")}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
PARTS = "CASE lower(x) " + " ".join(f"WHEN '{w.replace("'", "''")}' THEN {k}" for w, k in text.CONTRACTIONS.items()) + " ELSE 0 END"


@registered(
    f"""WITH w AS (SELECT doc_id, flatten(list_transform({TREEBANK}, lambda x: CASE WHEN {PARTS} > 0 THEN [substr(x, 1, {PARTS}), substr(x, {PARTS} + 1)] ELSE [x] END)) AS w FROM documents)
    SELECT doc_id, len(w)::BIGINT AS n, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM w"""
)
def doc_treebank_words(spark, d):
    """T12 by the Treebank's rules, on the texts as they are."""
    w = text.words(F.coalesce("text", F.lit("")))
    return read_table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), _digest(F.array_join(w, " ")))


@registered(
    f"""WITH {ART}, w AS (SELECT doc_id, list_filter({SPACED}, lambda x: regexp_matches(x, '[a-zA-Z]')) AS w FROM art),
    g AS (SELECT doc_id, flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' ')) for n in [1, 2, 3]]) AS g FROM w) SELECT doc_id, len(g)::BIGINT AS n, md5(coalesce(array_to_string(g, '|'), '')) AS digest FROM g"""
)
def doc_ngrams(spark, d):
    """T25."""
    g = text.ngrams(text.tokens(F.col("abstract")), 1, 3)
    return articles(spark, d).select(F.col("orig_index").alias("doc_id"), F.size(g).cast("long").alias("n"), _digest(F.array_join(g, "|")))


@registered(
    "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN c_name || '; X' WHEN 1 THEN c_name || ', AB; X' WHEN 2 THEN c_name || ', JM; X' ELSE 'Unknown; X' END AS authors, "
    "CASE c_custkey % 3 WHEN 0 THEN 'Roe, A; Poe, B' WHEN 1 THEN c_mktsegment ELSE 'Van, D' END AS cited FROM customer"
)
def author_formats(spark, d):
    """T19, T20."""
    c = read_table(spark, d, "customer")
    k = F.col("c_custkey")
    given = F.when(k % 4 == 1, "ann b.").when(k % 4 == 2, "Jo-mary").otherwise("")
    one = F.struct(given.alias("given"), F.when(k % 4 < 3, F.col("c_name")).alias("family"), F.lit(None).cast("string").alias("name"))
    two = F.struct(F.lit("").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("X").alias("name"))
    cited = F.when(k % 3 == 0, "Roe, Ann 0000-0001; Poe bob, 12").when(k % 3 == 1, F.col("c_mktsegment")).otherwise("Van, de Berg")
    return c.select(k.alias("k"), text.format_crossref_authors(F.array(one, two)).alias("authors"), text.format_citation_authors(cited).alias("cited"))


@registered("SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [k::VARCHAR, (k + 1)::VARCHAR, 'x'] ELSE [k::VARCHAR] END) AS member FROM (SELECT c_custkey AS k FROM customer)")
def cluster_member_ids(spark, d):
    """T23."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("merged_"), k.cast("string"), F.lit("_"), (k + 1).cast("string"), F.lit("_x"))).otherwise(k.cast("string"))
    return read_table(spark, d, "customer").select(k.alias("k"), F.explode(text.cluster_members(name)).alias("member"))


# --- parsers of answers ---------------------------------------------------------------------------------------


@registered("SELECT c_custkey AS k, c_name AS title, c_mktsegment || ', Z' AS authors, (1990 + c_custkey % 30)::VARCHAR AS year, c_custkey::VARCHAR AS pages, '10.1/' || c_custkey::VARCHAR AS doi, 'a; b' AS keywords FROM customer")
def answers_crossref(spark, d):
    """X11."""
    k = F.col("c_custkey")
    date = F.struct(F.array(F.array(1990 + (k % 30).cast("int"))).alias("date-parts"))
    work = F.struct(F.array("c_name").alias("title"), F.array(F.struct(F.lit("zoe").alias("given"), F.col("c_mktsegment").alias("family"))).alias("author"), date.alias("published-print"), k.cast("string").alias("page"), F.concat(F.lit("10.1/"), k.cast("string")).alias("DOI"), F.array(F.lit("a"), F.lit("b")).alias("subject"))
    w = enrich.parse_crossref(F.to_json(F.struct(work.alias("message"))))
    return read_table(spark, d, "customer").select(k.alias("k"), w.alias("w")).select("k", "w.title", "w.authors", "w.year", "w.pages", "w.doi", "w.keywords")


@registered("SELECT c_custkey AS k, 'A & ' || c_name AS title, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ', Q' END || '; B, R' AS authors, (1990 + c_custkey % 30)::VARCHAR AS year, 'x < y z' AS abstract FROM customer")
def answers_pubmed(spark, d):
    """X12."""
    k = F.col("c_custkey")
    first = F.concat(F.lit("<Author><LastName>"), F.col("c_mktsegment"), F.lit("</LastName>"), F.when(k % 2 == 0, "").otherwise("<Initials>Q</Initials>"), F.lit("</Author>"))
    xml = F.concat(F.lit("<A><PubDate><Year>"), (1990 + k % 30).cast("string"), F.lit("</Year></PubDate><ArticleTitle>A &amp; "), F.col("c_name"), F.lit("</ArticleTitle><AuthorList>"), first, F.lit("<Author><LastName>B</LastName><Initials>R</Initials></Author></AuthorList><AbstractText>x &lt; y</AbstractText><AbstractText>z</AbstractText></A>"))
    w = enrich.parse_pubmed(xml)
    return read_table(spark, d, "customer").select(k.alias("k"), w.alias("w")).select("k", "w.title", "w.authors", "w.year", "w.abstract")


@registered(
    "SELECT c_custkey AS orig_index, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'kept' END AS title, CASE WHEN length(c_comment) > 1.5 * 20 THEN trim(c_comment) ELSE repeat('x', 20) END AS abstract, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'BUILDING' END AS authors FROM (SELECT *, c_name || c_mktsegment || c_phone AS c_comment FROM (SELECT *, repeat('9', (c_custkey % 20)::INT) AS c_phone FROM customer))"
)
def answers_merged(spark, d):
    """Crossref's rules: a blank title is filled, a much longer abstract and other authors replace."""
    k = F.col("c_custkey")
    long = F.concat("c_name", "c_mktsegment", F.repeat(F.lit("9"), (k % 20).cast("int")))
    fields = [F.lit(None).cast("string").alias(f) for f in enrich.FIELDS if f not in ("title", "abstract", "authors")]
    found = F.struct(F.col("c_name").alias("title"), long.alias("abstract"), F.col("c_mktsegment").alias("authors"), *fields)
    a = read_table(spark, d, "customer").select(k.alias("orig_index"), F.when(k % 2 == 0, " ").otherwise("kept").alias("title"), F.repeat(F.lit("x"), 20).alias("abstract"), F.lit("BUILDING").alias("authors"), found.alias("w"))
    return enrich.update_from(a, "w", "crossref").select("orig_index", "title", "abstract", "authors")


# --- tables and decisions ---------------------------------------------------------------------------------------


@registered("SELECT row_number() OVER (ORDER BY c_name, c_custkey::VARCHAR) - 1 AS orig_index, c_name AS title, lower(c_mktsegment) AS abstract, c_mktsegment AS orig_abstract, '' AS doi FROM customer")
def article_numbers(spark, d):
    """S2, M3, F1, F2."""
    c = read_table(spark, d, "customer")
    blank = F.lit(None).cast("string")
    raw = c.select(*[{"Title": F.col("c_name"), "Abstract Note": F.col("c_mktsegment"), "Issue": F.col("c_custkey").cast("string")}.get(n, blank).alias(n) for n in schema.RENAMES])
    return schema.articles(raw, ["title", "issue"]).select("orig_index", "title", "abstract", "orig_abstract", "doi")


@registered("SELECT c_custkey AS orig_index, CASE c_custkey % 3 WHEN 0 THEN 'kept' ELSE 'dropped' END AS side, CASE c_custkey % 3 WHEN 1 THEN 'Irrelevant' END AS reason FROM customer WHERE c_custkey % 3 < 2")
def judgments_split(spark, d):
    """F12, F13, F16."""
    k = F.col("c_custkey")
    judged = read_table(spark, d, "customer").select(k.alias("orig_index"), F.col("c_name").alias("title"), F.when(k % 3 == 0, "k ").when(k % 3 == 1, "D").alias("user_judgment"))
    kept, log = quality.split_judgments(judged, judged.limit(0).drop("user_judgment").withColumn("reason_for_removal", F.lit("")))
    return kept.select("orig_index", F.lit("kept").alias("side"), F.lit(None).cast("string").alias("reason")).unionByName(log.select("orig_index", F.lit("dropped").alias("side"), F.col("reason_for_removal").alias("reason")))


@registered("SELECT unnest(CASE WHEN k % 5 = 0 THEN [k::VARCHAR, (k + 1)::VARCHAR] ELSE [k::VARCHAR] END) AS cluster, CASE k % 4 WHEN 0 THEN 'relevant' WHEN 1 THEN 'irrelevant' ELSE 'borderline' END AS label FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 < 3")
def judged_clusters(spark, d):
    """L1, T23."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("merged_"), k.cast("string"), F.lit("_"), (k + 1).cast("string"))).otherwise(k.cast("string"))
    review = read_table(spark, d, "customer").select(name.alias("cluster_id"), F.when(k % 4 == 0, " r").when(k % 4 == 1, "I").when(k % 4 == 2, "b").otherwise("x").alias("user_judgment"))
    return relevance.user_clusters(review)


@registered("SELECT c_custkey AS orig_index, CASE WHEN c_custkey % 5 = 1 THEN 'removed' ELSE 'active' END AS status, CASE WHEN c_custkey % 5 = 2 THEN 'reviewed' WHEN c_custkey % 5 = 1 THEN c_name ELSE c_name END AS title FROM customer")
def final_decisions(spark, d):
    """O9, D28; ids are repeated in the review."""
    k = F.col("orig_index")
    a = read_table(spark, d, "customer").select(F.col("c_custkey").alias("orig_index"), F.col("c_name").alias("title"))
    r = a.where(k % 5 < 3).withColumns({"title": F.lit("reviewed"), "Decision": F.when(k % 5 == 1, "r").when(k % 5 == 2, "A").otherwise("")})
    kept, log = decisions.apply_final(a, a.limit(0).withColumns({"reason_for_removal": F.lit(""), "removal_step": F.lit("")}), r.unionAll(r))
    return decisions.combined_view(kept.withColumn("status", F.lit("active")), log.withColumn("status", F.lit("removed"))).select("orig_index", "status", "title")


@registered(
    "WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY user_id) SELECT c_custkey AS orig_index, CASE WHEN e = 'view' THEN 'removed' ELSE 'active' END AS status, CASE WHEN e IN ('click', 'purchase') THEN e ELSE c_name END AS title, CASE WHEN e = 'view' THEN NULL ELSE coalesce(e = 'click', false) END AS grey FROM customer LEFT JOIN e ON user_id = c_custkey"
)
def manual_decisions(spark, d):
    """U, G and R."""
    last = read_table(spark, d, "events").groupBy(F.col("user_id").alias("orig_index")).agg(F.max_by("event_type", "event_id").alias("title"))
    e = F.col("title")
    dec = last.withColumn("update_flag", F.when(e == "view", "R").when(e == "click", "g").when(e == "purchase", " U ").otherwise(""))
    a = read_table(spark, d, "customer").select(F.col("c_custkey").alias("orig_index"), F.col("c_name").alias("title"))
    kept, log = decisions.apply_manual(a, a.limit(0).withColumns({"reason_for_removal": F.lit(""), "removal_step": F.lit("")}), dec, ["title"])
    return decisions.combined_view(kept.withColumn("status", F.lit("active")), log.withColumn("status", F.lit("removed"))).select("orig_index", "status", "title", F.col("grey_flag").alias("grey"))


@registered(f"WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS r FROM art) SELECT doc_id, CASE WHEN r = 1 THEN 'kept' ELSE 'quick merge' END AS step FROM r")
def doc_quick_merge(spark, d):
    """A10."""
    kept, gone = dedup.quick_merge(articles(spark, d).withColumn("group_id", F.col("doi")))
    return kept.select(F.col("orig_index").alias("doc_id"), F.lit("kept").alias("step")).unionByName(gone.select(F.col("orig_index").alias("doc_id"), F.col("removal_step").alias("step")))


# --- scores ------------------------------------------------------------------------------------------------------


@registered("WITH s AS (SELECT doc_id, 1 / (1 + n_chars::DOUBLE) AS s FROM documents), r AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT doc_id, round((s - lo) / (hi - lo), 9) AS similarity FROM s, r")
def doc_normalised_similarity(spark, d):
    """X3, X1."""
    return vectors.normalised_similarity(read_table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n")), "n").select("doc_id", F.round("similarity", 9).alias("similarity"))


@registered("SELECT doc_id, round(exp(-power(n_chars - 900.0, 2) / (2 * 400.0 * 400.0)), 9) AS weight FROM documents")
def doc_gaussian(spark, d):
    """X4."""
    return read_table(spark, d, "documents").select("doc_id", F.round(vectors.gaussian_dampen(F.col("n_chars").cast("double"), 900.0, 400.0), 9).alias("weight"))


ROWS = "x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE) + 0.001) AS e FROM embeddings), s AS (SELECT vec_id, e, list_sum(e) AS s, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS n FROM x), q AS (SELECT vec_id, n, e, list_transform(e, lambda v: v / s) AS p, list_transform(list_reverse(e), lambda v: v / s) AS q FROM s)"


@registered(
    f"""WITH {ROWS}, l AS (SELECT vec_id, n, unnest(e) AS e, unnest(p) AS p, unnest(q) AS q FROM q)
    SELECT vec_id, round(sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2), 6) AS hellinger, round(sqrt(greatest(0, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2))), 6) AS js, round(sqrt(sum(power(p - q, 2))), 6) AS euclidean, round(max(e / n), 6) AS top FROM l GROUP BY vec_id"""
)
def emb_distances(spark, d):
    """X8, X13, X14."""
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.001)
    t = read_table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    p, q = vectors.l1_normalise(F.col("e")), vectors.l1_normalise(F.reverse("e"))
    return t.select("vec_id", F.round(vectors.hellinger(p, q), 6).alias("hellinger"), F.round(vectors.jensen_shannon(p, q), 6).alias("js"), F.round(vectors.euclidean(p, q), 6).alias("euclidean"), F.round(F.array_max(vectors.l2_normalise(F.col("e"))), 6).alias("top"))


@registered(
    """WITH g AS (SELECT l_suppkey AS supplier, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY l_suppkey), b AS (SELECT *, CASE WHEN n <= 2 THEN 40.0 ELSE 100 / (1 + exp(-ln(ln(n)))) END + CASE WHEN n > 1 THEN 15 * ln(k) / ln(n) ELSE 0 END + 2.5 * ln(35) / ln(50) AS x FROM g)
    SELECT supplier, n::BIGINT AS n, k::BIGINT AS k, round(100 - least(greatest(x, 0.5), 99.5), 6) AS percentile, round(CASE WHEN n > 1 THEN least(greatest(1 / log10(n::DOUBLE * n), 0.05), 0.5) ELSE 0.5 END, 6) AS quantile, (5 * round_even(n / 5.0, 0))::BIGINT AS rounded FROM b"""
)
def adaptive_numbers(spark, d):
    """X5, X6, X7 for each supplier's rows and parts, as 35 groupings would use them."""
    g = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("k"))

    def numbers(parts):
        for pdf in parts:
            n, k = pdf["n"].tolist(), pdf["k"].tolist()
            yield pdf.assign(percentile=[round(float(cluster.adaptive_percentile(a, b, 35)), 6) for a, b in zip(n, k, strict=True)], quantile=[round(float(cluster.assignment_quantile(a)), 6) for a in n], rounded=[cluster.myround(a) for a in n])

    return g.mapInPandas(numbers, f"supplier {g.schema['supplier'].dataType.simpleString()}, n long, k long, percentile double, quantile double, rounded long")


@registered(
    """WITH p AS (SELECT vec_id AS k, label, 0.2 + 0.05 * (vec_id % 7) AS r1, 0.1 + 0.02 * (label % 5) AS i1, 0.15 + 0.03 * (vec_id % 11) AS r2, 0.3 + 0.01 * (vec_id % 3) AS i2 FROM embeddings),
    b AS (SELECT k, (r1 * 0.8 + r2 * 0.4) / 1.2 AS r, (i1 * 0.8 + i2 * 0.4) / 1.2 AS i, 0.1 * (label % 4) AS s FROM p), m AS (SELECT *, r - i AS c, r - power(greatest(s * 0.5, 0), 0.125) AS m FROM b), lim AS (SELECT min(c) AS c0, max(c) AS c1, min(m) AS m0, max(m) AS m1 FROM m)
    SELECT k, round(r, 6) AS p_relevant, round(0.5 * (c - c0) / (c1 - c0) + 0.5 * (m - m0) / (m1 - m0), 6) AS final_score FROM m, lim"""
)
def blended_scores(spark, d):
    """A21, L5."""
    e, k = read_table(spark, d, "embeddings"), F.col("vec_id")
    one = e.select(k.alias("k"), F.lit("x").alias("classifier"), (0.2 + 0.05 * (k % 7)).alias("p_relevant"), (0.1 + 0.02 * (F.col("label") % 5)).alias("p_irrelevant"), F.lit(0.0).alias("p_borderline"))
    two = e.select(k.alias("k"), F.lit("y").alias("classifier"), (0.15 + 0.03 * (k % 11)).alias("p_relevant"), (0.3 + 0.01 * (k % 3)).alias("p_irrelevant"), F.lit(0.0).alias("p_borderline"))
    m = spark.createDataFrame([("x", 0.8), ("y", 0.4)], "classifier string, f1 double")
    b = relevance.blend(one.unionByName(two), m, "k").join(e.select(k.alias("k"), (0.1 * (F.col("label") % 4)).alias("irrelevant_similarity")), "k").withColumn("irrelevant_coherence", F.lit(0.5))
    return relevance.final_scores(b).select("k", F.round("p_relevant", 6).alias("p_relevant"), F.round("final_score", 6).alias("final_score"))


@registered(
    f"""WITH {CENT}, r AS (SELECT e FROM x WHERE label % 3 = 0), m AS (SELECT vec_id, max(list_cosine_similarity(x.e, r.e)) AS s FROM x, r GROUP BY vec_id)
    SELECT vec_id, round(1 - list_cosine_similarity(e, c), 6) AS distance_to_centroid, (CASE WHEN x.label % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS coherence_weight, round(s, 6) AS similarity_to_relevant FROM x JOIN cent USING (label) JOIN m USING (vec_id)"""
)
def emb_relevance_features(spark, d):
    """L3: the nearest relevant vector among all of them."""
    e = _emb(spark, d).withColumn("label", F.when(F.col("cluster") % 3 == 0, "relevant").otherwise("unknown"))
    coh = e.select("cluster").distinct().where("cluster % 2 = 0").withColumn("coherence", F.lit(0.5))
    f = relevance.features(e, vectors.mean_vector(e, "cluster", "v"), coh, "v", "vec_id")
    return f.select("vec_id", F.round("distance_to_centroid", 6).alias("distance_to_centroid"), F.col("coherence_weight").cast("double").alias("coherence_weight"), F.round("similarity_to_relevant", 6).alias("similarity_to_relevant"))


@registered("WITH s AS (SELECT vec_id, label, unnest(range(len(embedding))) AS concept, unnest(embedding)::DOUBLE AS w FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, concept) AS r FROM s WHERE w <> 0) SELECT vec_id, concept::BIGINT AS concept, r::BIGINT AS rank FROM r WHERE r <= 3")
def emb_top_concepts(spark, d):
    """R1, R2."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return lsa.top_concepts(e, "vec_id", "v", 3).select("vec_id", F.col("concept").cast("long").alias("concept"), F.col("rank").cast("long").alias("rank"))


TERMS = "t AS (SELECT DISTINCT label AS cluster, 'term' || ((vec_id * vec_id) % 30)::VARCHAR AS term FROM embeddings)"


def _terms(spark, d):
    k = F.col("vec_id")
    return read_table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.concat(F.lit("term"), (k * k % 30).cast("string")).alias("term")).distinct()


@registered(f"WITH {TERMS} SELECT cluster, term FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.cluster = a.cluster AND b.term <> a.term AND contains(b.term, a.term))")
def terms_not_contained(spark, d):
    """R4."""
    return lsa.drop_contained(_terms(spark, d), "cluster")


@registered(
    f"""WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY term) AS rank FROM t), n AS (SELECT term, count(*) AS n FROM r GROUP BY term), m AS (SELECT CASE WHEN max(n) > 7 THEN floor(max(n) / 2) ELSE max(n) END AS m FROM n),
    c AS (SELECT r.*, n < m AS few FROM r JOIN n USING (term), m), k AS (SELECT *, bool_or(few) OVER (PARTITION BY cluster) AS has_few FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank, term) AS place FROM k WHERE few OR NOT has_few) SELECT cluster, term, rank::BIGINT AS rank FROM o WHERE place <= 4"""
)
def terms_infrequent(spark, d):
    """R9, A24."""
    from pyspark.sql import Window

    t = _terms(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("term")))
    return lsa.infrequent_terms(t, "cluster", 4).select("cluster", "term", F.col("rank").cast("long").alias("rank"))


@registered("WITH c AS (SELECT vec_id, label, CASE label % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS category FROM embeddings) SELECT category, least(count(*), 7)::BIGINT AS n, 0::BIGINT AS strays FROM c GROUP BY category")
def category_samples(spark, d):
    """How many rows of each category a seeded sample of seven has."""
    c = read_table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("category"), "label")
    s = relevance.sample_by_category(c, "vec_id", 7)
    stray = (F.col("label") % 2 == 0) != (F.col("category") == "even")
    return s.groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(stray, 1)).alias("strays"))


@registered("WITH f AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), g AS (SELECT n, unnest(range(4)) AS fold FROM f) SELECT sum(n)::BIGINT AS rows, 4::BIGINT AS folds, true AS even FROM f")
def stratified_folds(spark, d):
    """L4's folds: every row in one of them, labels spread evenly."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    n = relevance.folds(e, "vec_id", "label", 4).groupBy("label", "fold").agg(F.count("*").alias("n"))
    even = n.groupBy("label").agg((F.max("n") - F.min("n") <= 1).alias("even"), F.sum("n").alias("n"))
    return even.agg(F.sum("n").alias("rows"), F.lit(4).cast("long").alias("folds"), F.min("even").alias("even"))


@registered("WITH p AS (SELECT p_partkey AS k, p_name AS s, p_brand AS g FROM part), d AS (SELECT levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s), 1)::DOUBLE AS dist FROM p x JOIN p y ON x.g = y.g AND x.k < y.k) SELECT round(quantile_cont(dist, 0.4), 6) AS threshold FROM d WHERE dist <> 0 AND dist <> 1")
def edit_threshold(spark, d):
    """V18, J8."""
    from litsieve.operators.similarity_join import edit_distances

    _, pairs = edit_distances(read_table(spark, d, "part"), "p_partkey", "p_brand", "p_name")
    return spark.createDataFrame([(round(cluster.distance_threshold(pairs, 40.0, "many"), 6),)], "threshold double")


