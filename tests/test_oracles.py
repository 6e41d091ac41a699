"""Spark queries against their DuckDB oracles on the smallest scale (the
driver runs the full set at sf0.01; tools/check_oracles.py does it locally)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabstat.sources.fixtures import TABLES
from tests.conftest import SF001
from tools.check_oracles import compare

NAMES = [
    "prepare", "group_summary", "numeric_summary", "categorical_profile", "missing_report", "correlation_matrix",
    "histogram_bins", "parse_duration", "split_train_test", "split_stratified", "one_hot", "qq_points",
    "ks_normal", "ols_robust", "breusch_pagan", "forward_select_regression", "roc_curve", "pr_curve",
    "confusion_grid", "findings", "scan_csv", "gram_matrix",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    diff = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert diff is None, diff
