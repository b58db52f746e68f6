"""Rows that are equal, and keys that repeat, whatever the number of blocks."""

from litsieve.operators import cluster, relevance


def test_equal_points_each_get_their_centroid(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    centroids = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.1, 1.0])], "cluster int, centroid array<double>")
    got = sorted((r["id"], r["nearest"]) for r in cluster.assign_nearest(points, centroids, "v").collect())
    assert got == [(1, 7), (1, 7), (2, 8)]


def test_repeated_keys_give_one_row_in_one_block_as_in_many(spark, monkeypatch):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    targets = spark.createDataFrame([([1.0, 0.0],), ([0.9, 0.1],), ([0.5, 0.0],)], "v array<double>")
    one = sorted(map(tuple, relevance.max_cosine(points, targets, "id", "v").collect()))
    monkeypatch.setattr(relevance, "BLOCK", 1)
    assert sorted(map(tuple, relevance.max_cosine(points, targets, "id", "v").collect())) == one
    assert [k for k, _ in one] == [1, 2] and one[0][1] == 1.0
