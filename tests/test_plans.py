"""Physical plans of the headline queries: no nested loops, no row-at-a-time Python, no
window over a whole table, and bounds and columns that reach the scan."""

import re

import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from gridspark.operators.quantile import iqr_filter
from gridspark.sources.tables import Tables
from test_queries import FOLDER


def plan_of(df):
    """The plan with its long lists written out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_plan(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert banned not in plan
    assert not re.search(r"Window \[.*\], \[\s*\], \[", plan)


def test_ordered_windows_run_per_bucket(spark):
    plan = plan_of(entry.queries()["w1_forward_fill"](spark, FOLDER))
    assert "hashpartitioning(series_id" in plan and "_bucket" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["a1_hourly_mean"](spark, FOLDER))
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", plan)) == {"ts:timestamp,event_type:string,value:double", "ts:timestamp,event_type:string"}


def test_literal_bounds_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(iqr_filter(t.lineitem.select("l_orderkey", "l_extendedprice"), "l_extendedprice", 0.3))
    assert "GreaterThanOrEqual(l_extendedprice" in plan and "LessThanOrEqual(l_extendedprice" in plan
    plan = plan_of(t.events.where("ts >= TIMESTAMP '2024-01-05 00:00:00'"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_store_scans_read_the_wanted_dates_only(spark):
    plan = plan_of(entry.queries()["s3_bounded_scan"](spark, FOLDER))
    assert re.search(r"PartitionFilters: \[[^\]]*date", plan) and "PushedFilters: [IsNotNull(ts)" in plan


def test_grouped_quantiles_are_range_partitioned(spark):
    from pyspark.sql import functions as F

    from gridspark.operators.quantile import exact_quantiles

    hot = spark.range(20_000).select(F.lit("hot").alias("g"), F.rand(1).alias("v"))
    plan = plan_of(exact_quantiles(hot, "v", [0.5], "g", slices=16))
    # Values are ranked within (group, slice), never within a group.
    assert re.search(r"windowspecdefinition\(g#\d+, _slice#\d+, _v#\d+ ASC", plan)
    assert not re.search(r"windowspecdefinition\(g#\d+, _v#", plan)
