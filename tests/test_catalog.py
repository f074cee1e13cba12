"""Every query against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from weftline import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir_module}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def sf_dir_module():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, sf_dir_module, name):
    df = catalog.queries()[name](spark, sf_dir_module)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, result.fetchall())


def test_every_query_has_a_counterpart():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
