"""Registered queries against their SQL at the smallest scale; PEERSPARK_ALL=1 runs every one."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FEW = ["p1_usp_state", "p2_initiations", "p3_p4_rolling_activity", "p8_degrees_at_initiation", "p15_context_eligibility", "j1_last3_updates",
       "j3_edges", "j9_reconciliation", "f6_valid_pairs", "f15_reaction_delays", "io7_vector_dedup", "r4_membership", "k3_click_rates",
       "k17_thread_order", "q4_kaplan_meier", "q19_quantiles", "t3_normalised_tokens", "t13_kappa", "m7_id_index", "st2_tumbling_counts"]
NAMES = list(entry.queries()) if os.environ.get("PEERSPARK_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).collect()
    else:
        assert compare(spark, con, fn, sql, SF) == ""  # an empty result fails too


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
