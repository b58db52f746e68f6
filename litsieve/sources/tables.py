"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve import schema
from litsieve.sources import ordered
from litsieve.storage import remove_tree


def read_csv(spark: SparkSession, path: str, sep: str | None = ",", columns: str | None = None) -> DataFrame:
    """UTF-8, header, quoted line ends. Without a separator tabs are tried first, then commas."""
    if sep is None:
        by_tab = read_csv(spark, path, "\t", columns)
        return by_tab if len(by_tab.columns) > 1 else read_csv(spark, path, ",", columns)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (reader.schema(columns) if columns else reader).csv(path)


def read_search_results(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    return schema.articles(read_csv(spark, path), order)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def steps(spark: SparkSession, root: str) -> list[str]:
    """Saved versions below a root, oldest first."""
    if not exists(spark, root):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(f for f in found if f.startswith("v="))


def save_version(active: DataFrame, log: DataFrame, root: str, suffix: str = "") -> str:
    """Write both tables as a new version; earlier versions stay as backups and nothing that is read is overwritten."""
    spark = active.sparkSession
    n = max((int(v[2:].split("-")[0]) for v in steps(spark, root)), default=0) + 1  # numbers of dropped versions below it stay unused
    path = f"{root}/v={n:05d}{'-' + suffix if suffix else ''}"
    active.write.mode("errorifexists").parquet(f"{path}/active")
    log.write.mode("errorifexists").parquet(f"{path}/log")
    return path


def load_version(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: the newest version, or the named one."""
    found = steps(spark, root)
    if not found:
        raise FileNotFoundError(root)
    v = version or found[-1]
    return spark.read.parquet(f"{root}/{v}/active"), spark.read.parquet(f"{root}/{v}/log")


def write_review(df: DataFrame, path: str, sep: str = ",", overwrite: bool = False, order: Sequence[str] = ()) -> None:
    """One file that a person edits, sorted if asked for; written by all tasks and joined in order."""
    ordered.write_table(df.orderBy(*order) if order else df, path, sep, overwrite)


def read_judged(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """F16."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_csv(spark, path, sep)


def write_actions(actions: DataFrame, path: str) -> str:
    """Typed action rows as JSON; a taken name gets the next suffix."""
    spark, n, to = actions.sparkSession, 0, path
    while exists(spark, to):
        n += 1
        to = f"{path}_{n}"
    actions.write.json(to)
    return to


def titles_report(df: DataFrame, cluster: str = "cluster", title: str = "title", solo: int = 999) -> DataFrame:
    """Text lines of titles by cluster, single ones last."""
    g = df.groupBy(cluster).agg(F.array_sort(F.collect_list(title)).alias("titles"))
    name = F.when(F.col(cluster) == solo, "solo").otherwise(F.concat(F.lit("cluster "), F.col(cluster).cast("string")))
    return g.orderBy(F.col(cluster) == solo, cluster).select(F.concat_ws("\n", name, F.array_join("titles", "\n"), F.lit("")).alias("value"))


def title_lines(df: DataFrame, cluster: str = "cluster", title: str = "title", solo: int = 999) -> DataFrame:
    """S12 as one row a line, in order: a cluster's name, its titles sorted, a blank line; single ones last.

    Each line is a row of a global sort, so a cluster with a third of all titles is parted like any other. Null titles give no
    line, but keep their cluster's name; a null cluster comes first, as ``cluster null``; line ends in titles become spaces; copies stay.
    """
    own = df.select(F.col(cluster).alias("c"), F.regexp_replace(F.col(title).cast("string"), r"[\r\n]+", " ").alias("t"))
    of = own.select("c").distinct()
    name = F.when(F.col("c") == solo, "solo").otherwise(F.concat(F.lit("cluster "), F.coalesce(F.col("c").cast("string"), F.lit("null"))))
    heads = of.select("c", F.lit(0).alias("place"), name.alias("t"))
    ends = of.select("c", F.lit(2).alias("place"), F.lit("").alias("t"))
    rows = own.where("t is not null").select("c", F.lit(1).alias("place"), "t")
    last = F.coalesce(F.col("c") == solo, F.lit(False))
    return heads.unionByName(rows).unionByName(ends).orderBy(last, "c", "place", "t").select(F.col("t").alias("value"))


def write_titles(df: DataFrame, path: str, cluster: str = "cluster", title: str = "title", solo: int = 999, overwrite: bool = False) -> None:
    """The report as one text file."""
    ordered.write_lines(title_lines(df, cluster, title, solo), path, "titles.txt", overwrite=overwrite)


def cluster_report(info: DataFrame, terms: DataFrame, exemplars: DataFrame, by: str = "cluster") -> DataFrame:
    """``cluster, terms, titles, exemplar, order``, largest first."""
    from pyspark.sql import Window

    t = terms.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    j = info.join(t, by, "left").join(exemplars, by, "left")
    return j.select(by, F.array_join("terms", ", ").alias("terms"), F.array_join("titles", " | ").alias("titles"), "exemplar", F.row_number().over(Window.orderBy(F.desc(F.size("members")), by)).alias("order"))


def cluster_review(info: DataFrame, terms: DataFrame, exemplars: DataFrame, by: str = "cluster") -> DataFrame:
    """The clusters a person judges."""
    t = terms.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("Top Terms"))
    return info.join(t, by, "left").join(exemplars, by, "left").select(F.col(by).alias("cluster_id"), "Top Terms", F.col("exemplar").alias("Exemplar"), F.round("score", 2).alias("Coherence"), F.lit("").alias("user_judgment"))


def drop_version(spark: SparkSession, root: str, version: str) -> None:
    remove_tree(spark, f"{root}/{version}")
