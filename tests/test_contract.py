"""Contract queries against DuckDB on the smallest given tables, and the shape of their plans."""

from __future__ import annotations

import re

import pytest

from contract import ORACLES, QUERIES
from contract.check import connect, difference

SF_DIR = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duckdb():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_duckdb(spark, duckdb, name):
    assert difference(spark, duckdb, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", [
    "b8_group_any", "b9_nested_group", "b19_censor_dates", "b20_earliest_exit", "b22_measurement_change",
    "f1_feature_counts", "k3_drug_groups", "t3_t7_all_strata_at_once", "t8_stratify_with", "t9_stratify_without",
    "q7_compare_cohorts",
])
def test_no_pairs_without_a_key(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["p2_start_between"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    assert re.search(r"DataFilters: \[[^]]*o_orderdate", plan)
