"""Every query of session analytics against its SQL in DuckDB, on the driver's smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tallyspark.plans import lifecycle_queries, queries, view_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_without_the_llm_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tallyspark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(queries.QUERIES) and set(alone.oracle_sql()) == set(queries.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
