"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from marketloom.plans import registry
from marketloom.plans.views import quarters

registry.load()


@pytest.fixture(scope="module")
def db(tables):
    con = duckdb.connect()
    for p in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x)
    return x if x is None else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, tables, name):
    got = registry.QUERIES[name](spark, tables)
    rows, columns = got.collect(), got.columns
    told = db.execute(registry.ORACLE[name])
    names = [c[0] for c in told.description]
    want = told.fetchall()
    assert sorted(columns) == sorted(names)
    order = sorted(columns)
    a = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rows)
    b = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want)
    assert a == b


def test_guidance_of_every_quarter(spark, tables):
    """Quarters that no report shows are judged too."""
    keys = registry.QUERIES["guidance_nq_accuracy"](spark, tables).select("sym", "fy", "qn")
    own = quarters(spark, tables).select("sym", "fy", "qn")
    assert keys.exceptAll(own).count() == own.exceptAll(keys).count() == 0
