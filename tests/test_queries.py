"""Queries against DuckDB on the smallest tables, where those are at hand."""

import os

import duckdb
import pytest

from quiverlog import queries as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

CHOSEN = ["edge_two_hop", "edge_anon_bag", "edge_variable_predicate_join", "rule_union", "rule_co_supply", "tc_located_in", "tc_turns_nonlinear", "tc_bound_backward", "mutual_even_odd", "compound_cid", "normalizer_shared_support", "cls_by_object", "cls_compound_by_edges", "tombstone_and_reactivate", "aggregate_over_query"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, oracle, name):
    found = catalogue.QUERIES[name](spark, SF)
    expected = oracle.sql(catalogue.ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.select(*columns).fetchall())
