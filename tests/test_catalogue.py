"""Every registered query of the base library against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from litsieve.plans import catalogue

SLOW = {"lsa_svd", "ensemble_clusters", "relevance_cv"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())
    want = sorted(repr(tuple(map(norm, r))) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry_runs_and_names_agree(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_optional_package():
    root = Path(__file__).parent.parent
    for p in (root / "litsieve").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
