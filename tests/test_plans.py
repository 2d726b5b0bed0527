"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import drift, gates, rules
from sluicegate.operators import fingerprint as fp
from workload.tables import sales as read
from workload.tables import table

SMALL = "/root/testdata/sf0.001"
# The test session keeps the smallest sales table in memory, which would hide its scans.
UNCACHED = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_on_any_row_path(spark, sales):
    for df in (
        rules.violation_counts(sales, rules.sales_rules()),
        gates.validation_report(sales, "s"),
        fp.fingerprint(sales),
        drift.drift_by_column(sales, sales),
    ):
        assert not re.search("Python|MapInPandas|MapInArrow", plan(df))


def test_rules_are_one_scan_and_one_aggregation(spark):
    text = plan(rules.violation_counts(read(spark, UNCACHED), rules.sales_rules()))
    assert text.count("FileScan parquet [l_") == 1
    assert text.count("HashAggregate") == 2


def test_filters_and_columns_reach_the_scan(spark):
    df = table(spark, SMALL, "part").where(F.col("p_size") > 10).select("p_partkey")
    text = plan(df)
    assert "GreaterThan(p_size,10)" in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_size:int>", text)


def test_duplicates_shuffle_two_hashes_only(sales):
    text = plan(gates.duplicate_summary(sales))
    assert re.search(r"Exchange hashpartitioning\(hash_a#\d+L, hash_b#\d+L", text)


def test_data_rows_never_meet_in_an_unpartitioned_window(sales):
    assert not re.search(r"Window.*\n.*\n.*Exchange SinglePartition", plan(drift.numeric_distances(sales, sales, contract.DRIFT_FEATURES["numerical"])))
