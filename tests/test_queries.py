"""Every registered query runs on the smallest tables and equals its SQL on DuckDB."""

import collections
import decimal
import math

import pytest

import __spark_entry__ as E
from postlens.plans.oracle import all_oracles
from postlens.plans.registry import NO_SQL, load_all
from tests.conftest import SF_SMALL

TABLES = ["documents", "labels", "conversations", "events", "pages", "embeddings", "benchmark"]

def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["platform", "n_posts", "pct_negative", "pct_neutral", "pct_positive"]
    for r in rows:
        assert abs(r["pct_negative"] + r["pct_neutral"] + r["pct_positive"] - 100.0) < 1e-3


def test_every_query_has_sql():
    assert set(load_all()) - NO_SQL == set(all_oracles())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = load_all()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    assert len(cols) == len(set(cols))
    got = collections.Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(all_oracles()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    want = collections.Counter(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want
