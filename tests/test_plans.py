"""Physical plans are the ones meant: filters and columns reach the scan, ranks are cut before the exchange, small known
sides are broadcast, and no query needs a product of tables."""

import re

import pytest
from jobsift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_allow_list_reaches_scan(spark):
    p = plan(QUERIES["source_allowlist"](spark, SF))
    assert "In(o_orderpriority" in p and "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in p and "Exchange" not in p


def test_null_safe_filter_keeps_columns_narrow(spark):
    p = plan(QUERIES["exclude_nullsafe"](spark, SF))
    assert "l_extendedprice" not in p and "Exchange" not in p


@pytest.mark.parametrize("name", ["dedup_month", "dedup_within_shard", "stratified_sample"])
def test_ranks_are_cut_before_the_exchange(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in p and len(re.findall(r"^\(\d+\) Exchange", p, re.M)) == 1


def test_census_is_partial_and_top_k(spark):
    p = plan(QUERIES["source_census"](spark, SF))
    assert "TakeOrderedAndProject" in p and "partial_count" in p and "ReadSchema: struct<event_type:string>" in p


def test_semi_and_anti_joins(spark):
    assert "LeftSemi" in plan(QUERIES["universe_semi"](spark, SF))
    assert "LeftAnti" in plan(QUERIES["unpassed_pool"](spark, SF))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, name):
    if name in ("train_predict", "cnn_train_predict"):
        pytest.skip("fits a model when it is planned")
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
