"""Metadata enrichment (O1-O3, X10-X12): answers are parsed once, joined by id, and merged by column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.fuzzy import authors_match, title_matches
from litsieve.functions.text import format_citation_authors, format_crossref_authors, text, unescape_xml
from litsieve.operators.quality import missing_data_flag
from litsieve.sources.lookup import Transport, http, lookup
from litsieve.storage import materialize

_DATE = "struct<`date-parts`: array<array<int>>>"
_WORK = (
    "struct<title: array<string>, author: array<struct<given: string, family: string, name: string>>, published: " + _DATE + ", `published-print`: " + _DATE + ", `published-online`: " + _DATE
    + ", page: string, volume: string, issue: string, abstract: string, DOI: string, subject: array<string>, `container-title`: array<string>>"
)
FIELDS = ("title", "authors", "year", "journal", "volume", "issue", "pages", "abstract", "doi", "keywords")


def _work(w: Column) -> Column:
    """A work's fields."""
    parts = lambda d: F.try_element_at(F.try_element_at(w[d]["date-parts"], F.lit(1)), F.lit(1))
    year = F.coalesce(parts("published-print"), parts("published-online"), parts("published"))
    return F.struct(
        F.try_element_at(w["title"], F.lit(1)).alias("title"),
        format_crossref_authors(F.coalesce(w["author"], F.array())).alias("authors"),
        year.cast("string").alias("year"),
        F.try_element_at(w["container-title"], F.lit(1)).alias("journal"),
        w["volume"].alias("volume"),
        w["issue"].alias("issue"),
        w["page"].alias("pages"),
        w["abstract"].alias("abstract"),
        w["DOI"].alias("doi"),
        F.array_join(F.coalesce(w["subject"], F.array()), "; ").alias("keywords"),
    )


def parse_crossref(c: Column) -> Column:
    return _work(F.from_json(c, f"struct<message: {_WORK}>")["message"])


def parse_crossref_list(c: Column) -> Column:
    return F.transform(F.from_json(c, f"struct<message: struct<items: array<{_WORK}>>>")["message"]["items"], _work)


def parse_citations(c: Column) -> Column:
    """The first element of the answer."""
    w = F.try_element_at(F.from_json(c, "array<struct<title: string, author: string, page: string, year: string, volume: string, issue: string, source_title: string>>"), F.lit(1))
    none = F.lit(None).cast("string")
    return F.struct(w["title"].alias("title"), format_citation_authors(w["author"]).alias("authors"), w["year"].alias("year"), w["source_title"].alias("journal"), w["volume"].alias("volume"), w["issue"].alias("issue"), w["page"].alias("pages"), none.alias("abstract"), none.alias("doi"), none.alias("keywords"))


def _plain(c: Column) -> Column:
    """Text of an element: markup inside it goes, references are decoded."""
    return F.trim(unescape_xml(F.regexp_replace(c, "<[^>]*>", " ")))


def _tag(c: Column, tag: str) -> Column:
    v = F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.when(v != "", _plain(v))


def _tags(c: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), _plain)


def _authors(c: Column) -> Column:
    """``last, initials`` of each author, from within its own element; a group by its collective name."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)<Author\b[^>]*>(.*?)</Author>"), F.lit(1))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(c))  # names outside any author element
    names = F.transform(blocks, lambda a: F.concat_ws(", ", F.coalesce(_tag(a, "LastName"), _tag(a, "CollectiveName")), _tag(a, "Initials")))
    return F.array_join(F.filter(names, lambda n: n != ""), "; ")


def parse_pubmed(c: Column) -> Column:
    """Fields of a PubMed article."""
    return F.struct(
        _tag(c, "ArticleTitle").alias("title"),
        _authors(c).alias("authors"),
        _tag(F.regexp_extract(c, r"(?is)<PubDate\b.*?</PubDate>", 0), "Year").alias("year"),
        _tag(F.regexp_extract(c, r"(?is)<Journal\b.*?</Journal>", 0), "Title").alias("journal"),
        _tag(c, "Volume").alias("volume"),
        _tag(c, "Issue").alias("issue"),
        _tag(c, "MedlinePgn").alias("pages"),
        F.when(F.size(_tags(c, "AbstractText")) > 0, F.array_join(_tags(c, "AbstractText"), " ")).alias("abstract"),
        F.lit(None).cast("string").alias("doi"),
        F.array_join(_tags(c, "Keyword"), "; ").alias("keywords"),
    )


def merged(old: str, new: Column, rule: str) -> Column:
    """``longer`` replaces by a text more than 1.5 times as long, ``differs`` by any other value, ``blank`` fills only."""
    o, n = text(old), F.trim(F.coalesce(new, F.lit("")))
    if rule == "longer":
        use = F.length(n) > 1.5 * F.length(o)
    elif rule == "differs":
        use = (n != "") & (n != o)
    else:
        use = (n != "") & (F.trim(o) == "")
    return F.when(use, n).otherwise(o)


RULES = {
    "crossref": {"abstract": "longer", "authors": "differs", "pages": "differs"},
    "pubmed": dict.fromkeys(FIELDS, "differs") | {"doi": "blank"},
    "opencitations": {"authors": "differs", "pages": "differs"},
}


def update_from(df: DataFrame, found: str, service: str) -> DataFrame:
    """The article's fields after a service's answer (a struct column, null for none)."""
    rules = RULES[service]
    return df.withColumns({f: F.when(F.col(found).isNull(), text(f)).otherwise(merged(f, F.col(found)[f], rules.get(f, "blank"))) for f in FIELDS if f in df.columns})


def recover_dois(articles: DataFrame, transport: Transport = http, title_min: int = 80, author_min: int = 60, store: str | None = None) -> DataFrame:
    """O1: DOIs for ``auto`` rows from title searches confirmed by year (at most one off, D4), title and authors; others become ``manual``."""
    auto = articles.where("doi_recovery_flag = 'auto'")
    answers = lookup(auto, "orig_index", "title", "crossref_title", transport, store)
    hits = answers.select("orig_index", F.posexplode(parse_crossref_list(F.col("response"))).alias("place", "w"))
    j = auto.select("orig_index", "title", "authors", "year").join(hits, "orig_index")
    year_ok = F.abs(F.expr("try_cast(year as int)") - F.expr("try_cast(w.year as int)")) <= 1
    j = materialize(j.where(year_ok), "of-the-year")  # the cheap test first, whatever the optimiser would do
    ok = j.where(title_matches(F.col("title"), F.col("w.title"), title_min) & authors_match(F.col("authors"), F.col("w.authors"), author_min))
    best = ok.withColumn("r", F.row_number().over(Window.partitionBy("orig_index").orderBy("place"))).where("r = 1").select("orig_index", F.col("w.doi").alias("__doi"))
    out = articles.join(best, "orig_index", "left")
    flag = F.when((F.col("doi_recovery_flag") == "auto") & F.col("__doi").isNull(), "manual").otherwise(F.col("doi_recovery_flag"))
    return out.withColumns({"doi": F.coalesce("__doi", "doi"), "doi_recovery_flag": flag}).drop("__doi")


def retrieve_missing(articles: DataFrame, transport: Transport = http, store: str | None = None) -> DataFrame:
    """O2, O3: rows flagged ``auto`` ask Crossref, then PubMed, then OpenCitations by DOI; what is still blank is ``manual``."""
    flagged = missing_data_flag(articles)
    todo = flagged.where("data_ret_flag = 'auto'")
    rest = flagged.where("data_ret_flag <> 'auto'")
    for service, name, parse in (("crossref_doi", "crossref", parse_crossref), ("pubmed", "pubmed", parse_pubmed), ("opencitations", "opencitations", parse_citations)):
        ask = todo.where("data_ret_flag = 'auto'")
        answers = lookup(ask, "orig_index", "doi", service, transport, store)
        found = answers.where("response is not null").select("orig_index", parse(F.col("response")).alias("__w"))
        todo = materialize(missing_data_flag(update_from(todo.join(found, "orig_index", "left"), "__w", name).drop("__w")), "enriched")
    still = todo.withColumn("data_ret_flag", F.when(F.col("data_ret_flag") == "", "auto").otherwise("manual"))
    return rest.unionByName(still)
