"""Memory of the largest cosine to many targets."""

import tracemalloc

import numpy as np

from litsieve.operators import relevance


def test_products_are_sliced_whatever_the_batch():
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=(6000, 8)), rng.normal(size=(4096, 8))
    x[5] = 0
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    tracemalloc.start()
    got = relevance._largest(x, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # one product of all rows takes 197 MB
    size = np.linalg.norm(x, axis=1)
    want = [float((t @ v).max() / n) if n else 0.0 for v, n in zip(x, size, strict=True)]
    assert np.allclose(got, want)
