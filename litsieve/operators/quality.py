"""Filters, flags and quality checks (F3-F12 in the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import STOP_WORDS, text, tokens


def blank(c: str) -> Column:
    return F.trim(text(c)) == ""


def content_count(c: str, stop: list[str] | None = None) -> Column:
    """Tokens that hold a letter or digit and are no stop words."""
    words = F.array(*[F.lit(w) for w in (stop or STOP_WORDS)])
    return F.size(F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda t: (t != "") & ~F.array_contains(words, t)))


def flag_hollow(df: DataFrame, column: str = "abstract", quantile: float = 0.15, stop: list[str] | None = None) -> DataFrame:
    """``non_stop_words_density`` and ``hollow_flag``: strictly below the interpolated quantile.

    The threshold is one row from one aggregation, joined back as a scalar.
    """
    counted = df.withColumn("non_stop_words_density", content_count(column, stop))
    limit = counted.agg(F.percentile("non_stop_words_density", F.lit(quantile)).alias("hollow_limit"))
    return counted.crossJoin(F.broadcast(limit)).withColumn("hollow_flag", F.col("non_stop_words_density") < F.col("hollow_limit")).drop("hollow_limit")


def doi_recovery_flag(df: DataFrame) -> DataFrame:
    """``auto`` if title and authors can look a blank DOI up, else ``manual``; empty where there is a DOI."""
    return df.withColumn("doi_recovery_flag", F.when(~blank("doi"), "").when(~blank("title") & ~blank("authors"), "auto").otherwise("manual"))


def doi_manual_list(df: DataFrame) -> DataFrame:
    """The rows a person has to look up, in the review file's columns."""
    return df.where("doi_recovery_flag = 'manual'").select("orig_index", "title", F.lit("").alias("update_flag"), "authors", "journal", "year", "abstract", "doi", "hollow_flag")


def missing_data_flag(df: DataFrame) -> DataFrame:
    """F5."""
    lacks = blank("title") | blank("abstract") | blank("authors") | blank("year")
    return df.withColumn("data_ret_flag", F.when(lacks & ~blank("doi"), "auto").when(lacks, "manual").otherwise(""))


def word_count(c: str) -> Column:
    return F.size(tokens(text(c)))


def quality_checks(df: DataFrame, min_length: int = 100, year_min: int = 1900, year_max: int = 2024, languages: tuple[str, ...] = ("english",)) -> DataFrame:
    """Length, year, language and DOI checks, and ``needs_review`` as their OR. A blank year is out of range."""
    year = F.col("year").try_cast("int") if hasattr(Column, "try_cast") else F.expr("try_cast(year as int)")
    return (
        df.withColumn("abstract_length", word_count("abstract"))
        .withColumn("abstract_check", F.col("abstract_length") <= min_length)
        .withColumn("year_check", ~F.coalesce(year.between(year_min, year_max), F.lit(False)))
        .withColumn("language_check", (text("language") != "") & ~F.lower(text("language")).isin(*[x.strip().lower() for x in languages]))
        .withColumn("doi_check", blank("doi"))
        .withColumn("needs_review", F.col("abstract_check") | F.col("year_check") | F.col("language_check") | F.col("doi_check"))
    )


def as_flag(c: str) -> Column:
    """Numbers, strings and booleans as a flag; what is no number is unset."""
    s = F.lower(F.col(c).cast("string"))
    return (s == "true") | (F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) == 1)


def remove_flagged(active: DataFrame, log: DataFrame, flag: str, reason: str, step: str) -> tuple[DataFrame, DataFrame]:
    """rows with the flag set move to the log with reason and step; ``(active, log)``."""
    hit = F.coalesce(as_flag(flag), F.lit(False))
    gone = active.where(hit).withColumns({"reason_for_removal": F.lit(reason), "removal_step": F.lit(step)})
    return active.where(~hit), log.unionByName(gone, allowMissingColumns=True)


REENTRY = ["title", "year", "journal", "issn", "volume", "issue", "pages", "authors", "language", "abstract", "doi", "keywords", "orig_abstract", "orig_index", "non_stop_words_density", "hollow_flag", "doi_recovery_flag", "grey_flag", "data_ret_flag"]


def split_judgments(judged: DataFrame, log: DataFrame, reset_for_pipeline: bool = False) -> tuple[DataFrame, DataFrame]:
    """``K`` rows stay (only the re-entry columns if the pipeline starts over), ``D`` rows are logged as irrelevant."""
    u = F.upper(F.trim(text("user_judgment")))
    kept = judged.where(u == "K")
    kept = kept.select(*[c for c in REENTRY if c in judged.columns]) if reset_for_pipeline else kept.drop("user_judgment")
    dropped = judged.where(u == "D").withColumn("reason_for_removal", F.lit("Irrelevant"))
    return kept, log.unionByName(dropped, allowMissingColumns=True)
