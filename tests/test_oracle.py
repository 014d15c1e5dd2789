"""Every registered query with SQL equals DuckDB on the small tables (the driver's
check, run locally at sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from strata.plans import registry as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    # exact type correspondence, column by column
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    dtypes = {d[0]: str(d[1]) for d in res.description}
    for f in df.schema.fields:
        assert kinds.get(f.dataType.simpleString()) == dtypes[f.name], (f.name, f.dataType, dtypes[f.name])
    idx = {c: i for i, c in enumerate(dcols)}
    exp = sorted((tuple(_norm(r[idx[c]]) for c in cols) for r in res.fetchall()), key=_key)
    assert got == exp


def test_entry_smoke(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and df.columns[0] == "Life_Stage"


def test_every_query_has_sql_or_is_a_model_report():
    rows_only = {"rf_report", "rf_confusion", "rf_importance", "cv_accuracy", "model_comparison", "key_findings"}
    assert set(E.queries()) - set(SQL) == rows_only
