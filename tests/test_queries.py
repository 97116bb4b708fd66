"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert (row.roc_auc, row.n_pos + row.n_neg) == (pytest.approx(0.530965, abs=0.02), 150)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    assert sorted(got.columns) == names
    assert not [d for d in cur.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
