"""Exact deduplication and merging of duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import split_list, text
from litsieve.schema import numbered


def keep_first(df: DataFrame, key: str, order: str = "orig_index") -> tuple[DataFrame, DataFrame]:
    """A1, A4: ``(first rows, later rows)`` of each non-blank key; blank keys are all first.

    The first of each key comes from one partial aggregation, so a key that a third of the rows hold is
    combined before the shuffle; the join that marks the rows is left to adaptive skew handling.
    """
    k = F.trim(text(key))
    firsts = df.where(k != "").groupBy(k.alias("__k")).agg(F.min(order).alias("__first"))
    marked = df.withColumn("__k", k).join(firsts, "__k", "left")
    first = F.col("__first").isNull() | (F.col(order) == F.col("__first"))
    return marked.where(first).drop("__k", "__first"), marked.where(~first).drop("__k", "__first")


def remove_duplicate_dois(active: DataFrame, log: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """A1, A2: later rows of a DOI move to the log; ``dup_doi_cnt`` counts rows of the DOI over log and active."""
    kept, gone = keep_first(active, "doi")
    gone = gone.withColumns({"reason_for_removal": F.lit("Duplicate DOI"), "removal_step": F.lit(step)})
    both = log.unionByName(gone, allowMissingColumns=True)
    return kept, doi_counts(both, kept)


def doi_counts(log: DataFrame, active: DataFrame) -> DataFrame:
    """A3: the log with ``dup_doi_cnt`` over both tables; null for a blank DOI."""
    n = log.select("doi").unionAll(active.select("doi")).where(F.trim(text("doi")) != "").groupBy("doi").agg(F.count("*").alias("dup_doi_cnt"))
    return log.drop("dup_doi_cnt").join(n, "doi", "left")


def union_of(c: Column) -> Column:
    """Lowered, trimmed, distinct and sorted entries of ``;``-lists, joined by ``; `` (an aggregate)."""
    entries = F.flatten(F.collect_set(split_list(F.lower(F.coalesce(c, F.lit(""))))))
    return F.array_join(F.array_sort(F.array_distinct(entries)), "; ")


def longest(c: str) -> Column:
    """The longest value of a group; ties to the first in order (an aggregate)."""
    return F.max_by(F.col(c), F.struct(F.length(text(c)), -F.col("orig_index")))


def merge_groups(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """One synthesised row for each group.

    Longest journal, abstract and DOI, union of keywords and of authors, smallest numeric year; flags where
    years or DOIs differ. Everything is an aggregate with partial results.
    """
    year = F.expr("try_cast(year as int)")
    doi = F.when(F.trim(text("doi")) != "", F.col("doi"))
    return rows.groupBy(group).agg(
        F.min_by("title", "orig_index").alias("title"),
        longest("journal").alias("journal"),
        union_of(F.col("keywords")).alias("keywords"),
        union_of(F.col("authors")).alias("authors"),
        longest("abstract").alias("abstract"),
        F.min(year).alias("year"),
        longest("doi").alias("doi"),
        F.lit(True).alias("merged"),
        F.count("*").alias("merged_rows"),
        (F.count_distinct(text("year")) != 1).alias("flag_years"),
        (F.count_distinct(F.coalesce(doi, F.lit(""))) != 1).alias("flag_dois"),
    ).withColumn("to_review", F.col("flag_years") | F.col("flag_dois"))


def quick_merge(rows: DataFrame, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """A10: keep each group's first row; ``(kept, logged)``."""
    w = Window.partitionBy(group).orderBy("orig_index")
    r = rows.withColumn("__r", F.row_number().over(w))
    gone = r.where("__r > 1").drop("__r").withColumns({"reason_for_removal": F.lit("Duplicate"), "removal_step": F.lit("quick merge")})
    return r.where("__r = 1").drop("__r"), gone


def resolve_merges(active: DataFrame, log: DataFrame, members: DataFrame, quick: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Groups above the similarity limit keep their first row, the others become one merged row.

    ``members``: ``orig_index, group_id, group_mean_sim``. New ids follow the largest one in use.
    """
    m = members.select("orig_index", "group_id", "group_mean_sim")
    hit = active.join(m, "orig_index")
    rest = active.join(m, "orig_index", "left_anti")
    kept, gone_quick = quick_merge(hit.where(F.col("group_mean_sim") > quick))
    detail = hit.where(F.col("group_mean_sim") <= quick)
    top = active.select("orig_index").unionAll(log.select("orig_index")).agg(F.coalesce(F.max("orig_index"), F.lit(-1)).alias("top"))
    merged = numbered(merge_groups(detail).withColumn("year", F.col("year").cast("string")), ["group_id"], "place").crossJoin(F.broadcast(top)).withColumn("orig_index", (F.col("top") + 1 + F.col("place")).cast("long")).drop("top", "place")
    gone = detail.withColumns({"reason_for_removal": F.lit("Duplicate"), "removal_step": F.lit("detailed merge")})
    out = rest.unionByName(kept.drop("group_id", "group_mean_sim"), allowMissingColumns=True).unionByName(merged.drop("group_id", "merged_rows"), allowMissingColumns=True)
    log = log.unionByName(gone_quick.drop("group_id", "group_mean_sim"), allowMissingColumns=True).unionByName(gone.drop("group_id", "group_mean_sim"), allowMissingColumns=True)
    return out, log
