"""Plan properties: native operators stay in the JVM, scans are pruned."""

import re

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["user_features", "item_cooccurrence", "pit_features", "hourly_kpis",
                                  "assign_variants", "ab_significance", "recall_candidates", "price_change",
                                  "instant_interest", "session_features"])
def test_no_row_at_a_time_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_is_pruned_and_filtered(spark):
    df = entry.queries()["hourly_kpis_7d"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [set(re.findall(r"([a-z_]+)#", x)) for x in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)]
    # the log without unused columns, the catalogue's keys, and the newest time
    assert {"ts"} in scans and {"ts", "user_id", "event_type", "value", "props"} in scans and {"p_partkey"} in scans
    assert re.search(r"PushedFilters: \[[^\]]*event_type", plan)


@pytest.mark.parametrize("name", ["similar_topn", "category_topn", "recall_similar", "recommend"])
def test_top_k_per_group_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(entry.queries()[name](spark, SF_SMALL))


def test_ledger_queries_share_one_scan(spark):
    """The numbering and its bucket summary read one exchange."""
    for name in ("price_change", "orphan_rollbacks"):
        df = entry.queries()[name](spark, SF_SMALL)
        df.collect()
        final = _plan(df).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final, name


def test_cooccurrence_has_no_cartesian(spark):
    for name in ("item_cooccurrence", "recall_popular", "assign_variants", "duplicate_categories"):
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
