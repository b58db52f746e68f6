"""V30 over all rows: spectral clustering of landmarks, whose eigenvectors reach every other row by one matrix product."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.operators.cluster import SAMPLE, _squared, kmeans, sample_matrix, silhouette


@dataclass
class Spectrum:
    """The scaled eigenvectors of the landmarks' graph and the centres of its groups."""

    landmarks: np.ndarray
    width: float
    weights: np.ndarray  # of a landmark's likeness in each coordinate
    centres: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere of the leading eigenvectors; a landmark gets its own place.

        The row's degree and the likeness to its nearest landmark are common factors, so they need not be known and nothing
        underflows for a row that is far from all.
        """
        d2 = _squared(x, self.landmarks)
        u = np.exp((d2.min(axis=1, keepdims=True) - d2) / self.width) @ self.weights
        return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)

    def label(self, x: np.ndarray) -> np.ndarray:
        return _squared(self.place(x), self.centres).argmin(axis=1)


def fit_spectrum(x: np.ndarray, low: int = 2, high: int = 9) -> Spectrum | None:
    """The number of groups with the best silhouette on the landmarks; none for fewer than three of them or equal ones.

    Eigenvalues near zero would only spread noise, so a number of groups that needs one is left out.
    """
    if len(x) < 3:
        return None
    d2 = _squared(x, x)
    width = max(float(np.median(d2)), 1e-12)
    w = np.exp(-d2 / width)
    deg = 1 / np.sqrt(w.sum(axis=1))
    value, vec = np.linalg.eigh(w * deg[:, None] * deg[None, :])
    best, found = -math.inf, None
    for k in range(low, min(high, len(x) - 1) + 1):
        if value[-k] < 1e-9:
            break
        spectrum = Spectrum(x, width, deg[:, None] * vec[:, -k:] / value[-k:], np.zeros((k, k)))
        u = vec[:, -k:]
        _, spectrum.centres = kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)
        label = spectrum.label(x)
        if len(np.unique(label)) > 1 and (score := silhouette(x, label)) > best:
            best, found = score, spectrum
    return found


def spectral_table(df: DataFrame, key: str, vector: str, low: int = 2, high: int = 9, landmarks: int = SAMPLE) -> DataFrame:
    """``key, label, k`` for every row; ``landmarks`` rows (by a hash of the key) are the graph, which is exact if that is all rows.

    What travels with the tasks is the landmarks and ``high`` coordinates of each, whatever the table's size; each row is
    then one row of a matrix product, without a shuffle. Vectors that are null or hold null or non-finite components have a null label; rows
    that repeat a key each get one; equal vectors get equal labels. Fewer than three usable rows, or only equal ones, are one group 0; an
    empty table gives no rows. Vectors of several lengths are an error. Other columns are not read.
    """
    usable = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < math.inf)) & (F.size(vector) > 0), F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.when(usable, F.transform(vector, lambda v: v.cast("double"))).alias("vector"))
    _, x = sample_matrix(rows.where("vector is not null"), "key", "vector", landmarks)
    spectrum = fit_spectrum(x, low, high)
    k = 1 if spectrum is None else len(spectrum.centres)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            own = pdf["vector"].notna().to_numpy()
            label = pd.Series(pd.NA, index=pdf.index, dtype="Int32")
            if own.any():
                label[own] = 0 if spectrum is None else spectrum.label(np.stack(pdf.loc[own, "vector"]))
            yield pd.DataFrame({"key": pdf["key"], "label": label})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, label int").select(F.col("key").alias(key), "label", F.lit(k).alias("k"))
