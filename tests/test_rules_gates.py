from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import gates, rules
from sluicegate.schema import conform, normalise

ROW = (datetime.datetime(2025, 1, 6), "store_001", "Food", 1, 10.0, 5.0, 9.0, 20.0, 0, 1, 3.0, 7.0)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), contract.SALES_SCHEMA)


def changed(**values):
    return tuple(values.get(name, old) for name, old in zip(contract.SALES_COLUMNS, ROW, strict=True))


def broken(spark, row, rule_list=None):
    judged = rules.with_violations(table(spark, row), rule_list or rules.sales_rules())
    return judged.first()["violations"]


def test_clean_row_breaks_nothing(spark):
    assert broken(spark, ROW) == []


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"price": 0.0}, "price:gt_0"),
        ({"price": 10000.0}, "price:lt_10000"),
        ({"price": -10.0}, "price:gt_0"),
        ({"inventory_level": -0.5}, "inventory_level:ge_0"),
        ({"product_category": "INVALID"}, "product_category:one_of"),
        ({"store_id": "store_01"}, "store_id:matches"),
        ({"store_id": "xstore_001"}, "store_id:matches"),
        ({"temperature": 50.1}, "temperature:in_-30_50"),
        ({"promotion_flag": 2}, "promotion_flag:one_of"),
        ({"day_of_week": 7}, "day_of_week:in_0_6"),
        ({"month": 0}, "month:in_1_12"),
        ({"price": None}, "price:not_null"),
        ({"date": None}, "date:not_null"),
    ],
)
def test_each_bound(spark, values, expected):
    assert broken(spark, changed(**values)) == [expected]


def test_inclusive_bounds_hold(spark):
    row = changed(inventory_level=0.0, temperature=-30.0, previous_day_sales=0.0, sales_demand=0.0)
    assert broken(spark, row) == []


def test_missing_allowed_on_request(spark):
    assert broken(spark, changed(price=None), rules.sales_rules(allow_missing=True)) == []
    assert broken(spark, changed(temperature=55.0), rules.request_rules()) == []


def test_unconvertible_value_is_a_violation(spark):
    df = table(spark, ROW).withColumn("price", F.lit("abc"))
    assert rules.with_violations(df, rules.sales_rules()).first()["violations"] == ["price:is_double"]
    assert conform(df).first()["price"] is None


def test_quarantine_evaluates_a_cell_once_whatever_rules_read_it(spark):
    drawn = F.when(F.substring(F.md5(F.col("store_id")), 1, 1) < "0", F.lit(None)).otherwise(F.col("price"))
    df = table(spark, ROW, changed(price=-1.0), changed(price=None)).withColumn("price", drawn)
    for part, prices in zip(rules.quarantine(df, rules.sales_rules()), ([10.0], [-1.0, None]), strict=True):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1 and "lambda" not in plan
        assert [r["price"] for r in part.collect()] == prices
    assert rules.with_violations(df, []).first()["violations"] == []


def test_missing_column_and_extra_column(spark):
    df = table(spark, ROW).drop("price").withColumn("extra", F.lit(1))
    counted = {r["rule"]: r["n_violations"] for r in rules.violation_counts(df, rules.sales_rules()).collect()}
    assert counted["price:column_present"] == 1
    assert sum(counted.values()) == 1


def test_nan_becomes_missing(spark):
    df = normalise(table(spark, changed(price=float("nan"))))
    assert rules.with_violations(df, rules.sales_rules()).first()["violations"] == ["price:not_null"]


def test_all_failure_cases_and_first_error(spark):
    df = table(spark, changed(price=-1.0, inventory_level=-1.0), ROW).withColumn("id", F.monotonically_increasing_id())
    assert rules.failure_cases(df, rules.sales_rules(), ["id"]).count() == 2
    assert rules.first_error(df, rules.sales_rules(), ["id"]).count() == 1
    good, bad = rules.quarantine(df, rules.sales_rules())
    assert (good.count(), bad.count()) == (1, 1)


def test_duplicates_count_every_copy_after_the_first(spark):
    one = gates.duplicate_summary(table(spark, ROW, ROW, ROW, changed(price=None), changed(price=None))).first()
    assert (one["n_rows"], one["n_surplus"]) == (5, 3)


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert gates.duplicate_summary(df).first()["n_surplus"] == 0


def test_empty_table_has_zero_ratios_but_too_few_rows(spark):
    rows = {r["rule"]: r for r in gates.quality_gate(table(spark)).collect()}
    assert rows["max_missing_ratio"]["actual"] == 0.0
    assert rows["max_duplicate_ratio"]["actual"] == 0.0
    assert not rows["min_required_rows"]["passed"]


def test_half_missing_fails_the_gate(spark, sales):
    half = sales.select(*[F.when(F.xxhash64("price", "date") % 2 == 0, F.col(c)).alias(c) for c in sales.columns])
    rows = {r["rule"]: r["passed"] for r in gates.quality_gate(half).collect()}
    assert not rows["max_missing_ratio"]


@pytest.mark.parametrize(
    ("values", "passed"),
    [((50.0, 0.15, 0.85), True), ((250.0, 0.15, 0.85), False), ((50.0, 0.15, 0.40), False), ((150.0, 0.25, 0.5), True), ((50.0, 0.1, float("nan")), False)],
)
def test_model_gate(spark, values, passed):
    rows = spark.createDataFrame(list(zip(["rmse", "mape", "r2"], values, strict=True)), "metric string, value double")
    checks = gates.model_gate(rows, gates.threshold_table(spark), [])
    assert checks.count() == 3
    assert gates.gate_verdict(checks).first()["passed"] is passed


def test_readiness_treats_an_absent_gate_as_passed(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    data = spark.createDataFrame([("a", False, "")], "run string, passed boolean, failed_rules string")
    model = spark.createDataFrame([("a", False, "r2"), ("b", True, "")], "run string, passed boolean, failed_rules string")
    out = {r["run"]: r for r in gates.deployment_readiness(runs, data, model, ["run"]).collect()}
    assert [out[k]["status"] for k in "abc"] == ["REJECTED", "APPROVED", "APPROVED"]
    assert out["a"]["blocking_reasons"] == "data validation failed; model gate failed: r2"


def test_failure_cases_of_quoted_names(spark):
    name = "it's `x` \\"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string").withColumnRenamed("x", name)
    found = rules.failure_cases(df, [rules.not_null(name), rules.one_of(name, ["b"])], ["id"]).collect()
    assert {(r["id"], r["column_name"], r["check_name"], r["failure_case"]) for r in found} == {(1, name, "one_of", "a"), (2, name, "not_null", None)}
