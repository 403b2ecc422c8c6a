"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

import gridmetric.plans as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _rows(frame, columns):
    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, str)) or type(v).__name__ in ("bool", "bool_"):
            return str(v)
        return f"{float(v):.7g}"

    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, data, duck, name):
    got, want = plans.QUERIES[name](spark, data).toPandas(), duck.execute(plans.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - {"logreg_stacker"}))
def test_query_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0
