"""The registered queries against their SQL on the smallest tables.

By default a few that span the library; all of them with TIDEPANEL_ALL=1 (or tools/check.py).
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
FEW = ["panel_build", "fill_linear", "or_variables", "auc_documents", "most_recent_n", "ljung_box"]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("TIDEPANEL_ALL") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = contract.queries()[name](spark, FOLDER)
    result = tables.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = check.rows_of(names, result.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["series_id", "ts", "any_anomaly"]
