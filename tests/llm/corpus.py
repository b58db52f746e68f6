"""Small awkward document tables for the tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, length string, rank string, value string, shard string"


def documents(spark, rows):
    """``rows``: (doc_id, text); further columns carry names that the operators use inside."""
    full = [(i, t, "en", "src0", None if t is None else len(t), "b", "l", None, "v", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ODD = [
    (1, "plain words here"),
    (1, "plain words here"),
    (2, None),
    (3, ""),
    (4, "  two  spaces \n and\tlines   x "),
    (5, LONG),
    (None, "no id"),
    (6, "été 你好 \U0001f600 <|endoftext|> tail"),
    (7, "x" * 5000),
    (8, LONG),
    (-9, "negative id"),
]


def empty(spark):
    return documents(spark, []).where(F.lit(False))
