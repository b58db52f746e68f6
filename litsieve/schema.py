"""Table shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The export's column names and the table's.
RENAMES = {
    "Title": "title",
    "Publication Year": "year",
    "Publication Title": "journal",
    "ISSN": "issn",
    "Volume": "volume",
    "Issue": "issue",
    "Pages": "pages",
    "Author": "authors",
    "Language": "language",
    "Abstract Note": "abstract",
    "DOI": "doi",
    "Manual Tags": "keywords",
}
ARTICLE = "title string, year string, journal string, issn string, volume string, issue string, pages string, authors string, language string, abstract string, doi string, keywords string, orig_abstract string, orig_index long"
REMOVAL_LOG = ARTICLE + ", reason_for_removal string, removal_step string, dup_doi_cnt long"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """F14."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def articles(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The twelve columns renamed, nulls blank, lowered abstract with the original beside it, and ``orig_index``.

    The id is the position in a stable order (``order``, else all columns): counted by partition offsets of a
    range sort, not in one task.
    """
    require(raw, list(RENAMES))
    t = raw.select(*[F.coalesce(F.col(f"`{a}`").cast("string"), F.lit("")).alias(b) for a, b in RENAMES.items()])
    t = t.withColumn("orig_abstract", F.col("abstract")).withColumn("abstract", F.lower("abstract"))
    keys = order or list(RENAMES.values())
    return numbered(t, keys, "orig_index")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A dense 0.. number in the given order without a single-task window."""
    from pyspark.sql import Window

    from litsieve.storage import materialize

    placed = materialize(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__p").orderBy(*order)
    return placed.withColumn("__r", F.row_number().over(inside) - 1).join(F.broadcast(base), "__p").withColumn(name, (F.col("__base") + F.col("__r")).cast("long")).drop("__p", "__r", "__base")


def empty_log(spark) -> DataFrame:
    return spark.createDataFrame([], REMOVAL_LOG)
