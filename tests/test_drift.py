from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.tails import chi_square_p, kolmogorov_p, two_sided_normal_p
from sluicegate.operators import drift, inject
from sluicegate.plans import monitor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "df"), [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5), (30.143527, 19)])
def test_chi_square_critical_values(spark, x, df):
    assert one(spark, chi_square_p(F.lit(x), F.lit(df))) == pytest.approx(0.05, abs=1e-6)


def test_tails_at_the_edges(spark):
    assert one(spark, chi_square_p(F.lit(0.0), F.lit(3))) == 1.0
    assert one(spark, chi_square_p(F.lit(5.0), F.lit(0))) == 1.0
    assert one(spark, chi_square_p(F.lit(1e12), F.lit(4))) == 0.0
    assert one(spark, chi_square_p(F.lit(2000.0), F.lit(2000))) == pytest.approx(0.4958, abs=1e-3)
    assert one(spark, two_sided_normal_p(F.lit(-1.959964))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, two_sided_normal_p(F.lit(1.0))) == pytest.approx(math.erfc(1 / math.sqrt(2)), abs=1e-12)
    assert one(spark, kolmogorov_p(F.lit(0.0), F.lit(10), F.lit(10))) == 1.0
    lam = 1.358099  # the 5% point of the Kolmogorov distribution
    assert one(spark, kolmogorov_p(F.lit(lam), F.lit(2.0), F.lit(2.0))) == pytest.approx(0.05, abs=1e-5)


def numbers(spark, low, high):
    return spark.range(low, high).select(F.col("id").cast("double").alias("v"))


def test_identical_tables_have_no_distance(spark):
    d = drift.numeric_distances(numbers(spark, 0, 500), numbers(spark, 0, 500), ["v"]).first()
    assert (d["ks"], d["wasserstein"]) == (0.0, 0.0)
    assert not drift.ks_test(drift.numeric_distances(numbers(spark, 0, 50), numbers(spark, 0, 50), ["v"])).first()["drifted"]


def test_disjoint_supports(spark):
    d = drift.numeric_distances(numbers(spark, 0, 100), numbers(spark, 1000, 1100), ["v"]).first()
    assert d["ks"] == 1.0
    spread = math.sqrt((100**2 - 1) / 12)
    assert d["wasserstein"] == pytest.approx(1000 / spread)


def test_ks_is_symmetric(spark):
    a, b = numbers(spark, 0, 300), numbers(spark, 100, 450)
    left = drift.numeric_distances(a, b, ["v"]).first()["ks"]
    assert left == pytest.approx(drift.numeric_distances(b, a, ["v"]).first()["ks"])
    assert left == pytest.approx(3 / 7)


def categories(spark, **counts):
    rows = [(k,) for k, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string")


def test_chi_square_by_hand(spark):
    counts = drift.category_counts(categories(spark, a=50, b=50), categories(spark, a=30, b=70), ["c"])
    row = drift.chi_square_test(counts).first()
    assert row["score"] == pytest.approx(16.0)
    assert row["df"] == 1
    assert row["drifted"]
    js = drift.jensen_shannon_test(counts).first()["score"]
    want = math.sqrt(0.5 * (0.5 * math.log2(0.5 / 0.4) + 0.5 * math.log2(0.5 / 0.6) + 0.3 * math.log2(0.3 / 0.4) + 0.7 * math.log2(0.7 / 0.6)))
    assert js == pytest.approx(want)


def test_unseen_and_single_category(spark):
    unseen = drift.chi_square_test(drift.category_counts(categories(spark, a=10), categories(spark, a=9, z=1), ["c"])).first()
    assert unseen["drifted"] and unseen["p_value"] == 0.0
    single = drift.chi_square_test(drift.category_counts(categories(spark, a=10), categories(spark, a=4), ["c"])).first()
    assert single["p_value"] == 1.0 and not single["drifted"]


def test_nulls_are_left_out(spark):
    ref = numbers(spark, 0, 100).unionByName(spark.createDataFrame([(None,)] * 5, "v double"))
    assert drift.numeric_distances(ref, numbers(spark, 0, 100), ["v"]).first()["n_ref"] == 100


def test_date_and_target_are_not_features(sales):
    assert drift.common_features(sales, sales.drop("price")) == sorted(set(sales.columns) - {"date", "sales_demand", "price"})


@pytest.mark.parametrize(
    ("share", "drifted", "decision"),
    [
        (0.10, ["temperature"], "CONTINUE"),
        (0.35, ["temperature", "month"], "INVESTIGATE"),
        (0.65, ["price", "temperature", "month", "inventory_level"], "RETRAIN_REQUIRED"),
        (0.15, ["price"], "INVESTIGATE"),
        (0.20, [], "CONTINUE"),
        (0.50, [], "INVESTIGATE"),
    ],
)
def test_decisions(spark, share, drifted, decision):
    df = spark.createDataFrame([("s", share, drifted)], "scenario string, drift_share double, drifted_columns array<string>")
    decided = drift.drift_decision(df)
    assert decided.first()["decision"] == decision
    requests = drift.retrain_requests(decided, ["scenario"]).collect()
    assert len(requests) == (decision == "RETRAIN_REQUIRED")


def test_monitor_end_to_end(sales):
    current = inject.apply_scenario(sales, "severe_drift")
    out = monitor.monitor(sales, current, "severe_drift")
    row = out["decision"].first()
    assert row["n_columns"] == sum(len(v) for v in contract.DRIFT_FEATURES.values())
    assert {"price", "temperature", "promotion_flag", "product_category"} <= set(row["drifted_columns"])
    same = monitor.monitor(sales, sales, "clean")["decision"].first()
    assert (same["n_drifted"], same["decision"]) == (0, "CONTINUE")


def test_columns_without_values(spark):
    schema = "price double, temperature double, promotion_flag int, store_id string, month string, day_of_week string"
    full = spark.createDataFrame([(float(i), float(i), i % 2, f"s{i % 3}", "1", "a") for i in range(60)], schema)
    kinds = {"numerical": ["price", "temperature"], "binary": ["promotion_flag"], "categorical": ["store_id", "month"]}
    empty = full.withColumns({c: F.lit(None).cast(t) for c, t in full.dtypes if c in ("price", "promotion_flag", "store_id")})
    none = full.withColumns({c: F.lit(None).cast(t) for c, t in full.dtypes})
    for tests in ({}, {"numerical_test": "wasserstein", "categorical_test": "jensenshannon"}):
        for a, b in ((full, empty), (empty, full)):
            rows = {r["feature"]: r for r in drift.drift_by_column(a, b, kinds, **tests).collect()}
            assert set(rows) == {"price", "temperature", "promotion_flag", "store_id", "month"}
            assert all(rows[c]["drifted"] and rows[c]["score"] is None for c in ("price", "promotion_flag", "store_id"))
            assert not rows["temperature"]["drifted"] and not rows["month"]["drifted"]
        rows = drift.drift_by_column(none, none, kinds, **tests).collect()
        assert len(rows) == 5 and not any(r["drifted"] for r in rows)


def test_chi_square_tail_for_all_sizes(spark):
    # Reference values: upper tails of the chi-square distribution.
    known = [(3.841458820694124, 1, 0.05), (1.0, 2, math.exp(-0.5)), (40.0, 2, math.exp(-20.0)), (100.0, 100, 0.481191684527957)]
    df = spark.createDataFrame(known, "x double, df int, p double").withColumn("found", chi_square_p(F.col("x"), F.col("df")))
    assert all(r["found"] == pytest.approx(r["p"], rel=1e-9) for r in df.collect())
    # Both methods, where one takes over from the other, against the series summed in Python.
    def tail(x, d):
        term = total = 1.0
        for k in range(1, 2000):
            term *= x / 2 / (d / 2 + k)
            total += term
        return 1 - total * math.exp(-x / 2 + d / 2 * math.log(x / 2) - math.lgamma(d / 2 + 1))

    near = spark.createDataFrame([(x, d) for d in (399, 400, 401, 402) for x in (350.0, 400.0, 450.0)], "x double, df int")
    for r in near.withColumn("p", chi_square_p(F.col("x"), F.col("df"))).collect():
        assert r["p"] == pytest.approx(tail(r["x"], r["df"]), abs=1e-8)
    big = spark.range(1).select(chi_square_p(F.lit(1e8), F.lit(100_000_000))).first()[0]
    assert big == pytest.approx(0.5, abs=1e-4)
