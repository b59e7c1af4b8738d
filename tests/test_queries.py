"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from siltflow.queries import catalog, runs, streams

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | streams.QUERIES | runs.QUERIES, catalog.ORACLES | streams.ORACLES | runs.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(norm, r)) for r in df.select(columns).collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_route_artifacts_repeat(spark):
    runs = [sorted(map(tuple, QUERIES["route_artifacts"](spark, SF).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
