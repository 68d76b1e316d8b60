"""Shapes of plans: pruned scans, pushed filters, no pairwise products, no Python in the hot path."""

import re

import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_two_columns_reach_the_scan(spark):
    text = plan(registry.queries()["fanin_quintile"](spark, SF))
    assert set(re.findall(r"ReadSchema: (.*)", text)) == {"struct<l_partkey:bigint,l_suppkey:bigint>"}


def test_filters_are_pushed(spark):
    from pyspark.sql import functions as F

    from strandline.plans.bindings import file_edges, snapshots

    text = plan(file_edges(spark, SF).filter("type = 'tested-by'"))
    assert "EqualTo(l_returnflag,R)" in text and text.count("Scan parquet") <= 2  # the other branches fold away
    old, _ = snapshots(spark, SF)
    assert "EqualTo(l_linestatus,O)" in plan(old.select(F.count("*")))


@pytest.mark.parametrize("name", ["degree_in_out", "edge_dedupe_confidence", "dangling_refs", "drift_changed", "interface_satisfaction", "issue_frontier", "ledger_rebind_orphan_ambiguous", "smallest_enclosing", "longest_prefix_match", "tokenize_text", "normalized_body", "fold_symbols"])
def test_joins_have_keys_and_stay_in_the_jvm(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", text)
