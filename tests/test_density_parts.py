"""Density clusters of a full cell: how often a row is dealt, and slices of blocks."""

import numpy as np

from litsieve.operators import density
from tests.test_density import expected, table


def test_a_row_is_dealt_to_a_bounded_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 20)
    monkeypatch.setattr(density, "PARTS", 4)
    seen = []
    tiled = density._tiled

    def counted(*args):
        made = tiled(*args)
        seen.append(made().count())
        return made

    monkeypatch.setattr(density, "_tiled", counted)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.12, (170, 5)) for c in (0.0, 0.5)] + [rng.uniform(-0.6, 1.1, (60, 5))])
    keys = rng.permutation(len(x)).tolist()
    got = density.dbscan_table(table(spark, x, keys), "id", "v", 0.35, 5)
    assert sorted(map(tuple, got.collect()), key=str) == expected(x, keys, 0.35, 5)
    assert len({r["cluster"] for r in got.collect()}) > 2
    # blocks of 20 rows would deal each row about 20 times for the cells that touch
    near_cells = 9
    assert seen[0] <= len(x) * (density.PARTS + near_cells + 1)
