"""Edit distance and fuzzy matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def normalised_levenshtein(a: Column, b: Column) -> Column:
    """Distance over the longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def partial_ratio(a: str, b: str) -> int:
    """Best alignment of the shorter string in the longer one, 0..100: 2 * matches / both lengths.

    Matches are those of an insert/delete alignment (a longest common subsequence); windows of the shorter
    length slide over the longer text, and may hang over its ends.
    """
    if not a or not b:
        return 0 if a or b else 100
    short, long = sorted((a, b), key=len)
    n, best = len(short), 0.0
    full = (1 << n) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    masks = [places.get(c, 0) for c in long]
    for k in range(1 - n, len(long)):
        w = masks[max(k, 0) : k + n]
        if 2 * min(n, len(w)) / (n + len(w)) <= best:
            continue
        v = full  # a zero bit for each match of the common subsequence so far (Hyyro)
        for mask in w:
            u = v & mask
            v = ((v + u) | (v - u)) & full
        best = max(best, 2 * (n - v.bit_count()) / (n + len(w)))
        if best == 1.0:
            break
    return round(100 * best)


@F.pandas_udf(IntegerType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def title_matches(a: Column, b: Column, threshold: int = 80) -> Column:
    """T17."""
    return partial_ratio_udf(F.lower(a), F.lower(b)) > threshold


def authors_match(a: Column, b: Column, threshold: int = 60) -> Column:
    """``;``-lists joined by spaces."""
    flat = lambda c: F.array_join(F.transform(F.split(F.lower(c), ";"), lambda x: F.trim(x)), " ")
    return partial_ratio_udf(flat(a), flat(b)) > threshold
