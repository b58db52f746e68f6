"""Vectors as ``array<double>`` columns (J10, X8, X13, X14) and columnwise scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """J10; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l2_normalise(a: Column) -> Column:
    """X8; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def l1_normalise(a: Column) -> Column:
    n = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def hellinger(p: Column, q: Column) -> Column:
    """X13 for two L1-normalised rows."""
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)) / F.sqrt(F.lit(2.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance, natural logarithms."""

    def half(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.ln(v / m)).otherwise(F.lit(0.0))
        return (part(x) + part(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, half), F.lit(0.0), lambda s, x: s + x)))


def mean_vector(df: DataFrame, by: str, vector: str) -> DataFrame:
    """``by, centroid, size``; one partial aggregation on (group, dimension)."""
    long = df.select(by, F.posexplode(vector).alias("i", "x"))
    flat = long.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("size"))


def with_range(df: DataFrame, *cols: str) -> DataFrame:
    """``<c>_min`` and ``<c>_max`` of whole columns on every row, by one aggregate row and no global window."""
    one = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "min"), (F.max, "max"))])
    return df.crossJoin(F.broadcast(one))


def min_max(df: DataFrame, c: str, out: str) -> DataFrame:
    """X1 over all rows; null where all are equal."""
    return with_range(df, c).withColumn(out, F.try_divide(F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min"))).drop(f"{c}_min", f"{c}_max")


def by_max(df: DataFrame, c: str, out: str) -> DataFrame:
    """X2 over all rows."""
    return with_range(df, c).withColumn(out, F.try_divide(F.col(c), F.col(f"{c}_max"))).drop(f"{c}_min", f"{c}_max")


def normalised_similarity(df: DataFrame, distance: str, out: str = "similarity") -> DataFrame:
    """``1 / (1 + d)``, then min-max over all rows."""
    s = with_range(df.withColumn(out, 1 / (1 + F.col(distance))), out)
    return s.withColumn(out, F.try_divide(F.col(out) - F.col(f"{out}_min"), F.col(f"{out}_max") - F.col(f"{out}_min"))).drop(f"{out}_min", f"{out}_max")


def gaussian_dampen(x: Column, mean: float, sigma: float) -> Column:
    """X4."""
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * sigma * sigma))
