"""A spread of registered queries against their oracles on the smallest data."""

import glob
import os

import duckdb
import pytest

from tagloom.catalogue import ORACLES, QUERIES
from tests.conftest import DATA
from tools.check_oracles import compare

CHOSEN = [
    "csv_round_trip", "merge_outer", "asof_backward_by_unit", "interval_enrich", "period_stats", "describe", "time_rolling",
    "resample_hourly", "outliers", "corr_matrix", "decompose", "ridge_matrix", "gd_history", "findings_priority", "contact_cards",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], DATA).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
