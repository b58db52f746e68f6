"""Runs of words that repeat inside one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import remove_all, text, windows


def repeated_windows(df: DataFrame, key: str, column: str, size: int = 5, over: int = 5, ignore: list[str] | None = None) -> DataFrame:
    """``key, term, count, first``: windows seen more than ``over`` times in one document, with their first place.

    Texts go to their key's task whole and are cut there, so the windows, ``size`` times the text, are never shuffled.
    """
    rows = df.select(key, text(column).alias("__text")).repartition(F.col(key))
    w = rows.select(key, F.posexplode(windows(F.col("__text"), size)).alias("at", "term"))
    if ignore:
        w = w.where(~F.col("term").isin(*ignore))
    return w.groupBy(key, "term").agg(F.count("*").alias("count"), F.min("at").alias("first")).where(F.col("count") > over)


def remove_repeated(df: DataFrame, key: str, column: str, **options) -> tuple[DataFrame, DataFrame]:
    """The table without those runs, removed in first-seen order, and the log of terms with their totals."""
    found = repeated_windows(df, key, column, **options)
    per = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "term"))), lambda s: s["term"]).alias("__terms"))
    cleaned = df.join(per, key, "left").withColumn(column, F.when(F.col("__terms").isNull(), F.col(column)).otherwise(remove_all(text(column), F.col("__terms")))).drop("__terms")
    log = found.groupBy(F.col("term").alias("Removed Term")).agg(F.sum("count").alias("Count"))
    return cleaned, log
