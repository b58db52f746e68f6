"""Distances of label classes are shared out."""

from pyspark.sql import functions as F

from litsieve.operators import cluster


def test_one_file_of_classes_is_no_one_task(spark):
    rows = spark.createDataFrame([(k, [k % 3, k % 5, k % 7]) for k in range(60)], "id long, labels array<int>").coalesce(1)
    out = cluster.edit_distances(rows, "id", "labels")
    tasks = {r["p"]: r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(tasks.values()) == 60 * 59 // 2 and max(tasks.values()) < 900
