"""Every query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from terradelta.plans.oracle import oracle_sql
from terradelta.plans.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", ("snapshot_diff_status", "status_union_missing_cols", "external_eval_best_match", "removed_behavior", "stratified_sample_counts", "polygon_best_overlap", "polygon_external_match", "polygon_best_any"))
def test_no_side_is_broadcast(spark, name):
    """Nor planned to be by a table's small files: Spark doesn't know how many rows explode makes of them."""
    assert "Broadcast" not in queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
