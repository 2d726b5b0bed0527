"""Drift under all scenarios from one counted table, against each scenario by itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import drift, inject
from sluicegate.session import settle

MIXED = {
    "faults": {"missing_ratio": 0.2, "duplicate_ratio": 0.3, "negative_price_ratio": 0.2, "negative_inventory_ratio": 0.1, "invalid_category_ratio": 0.1},
    "drift": {"price_shift_factor": 1.3, "promotion_frequency_boost": 0.3, "category_mix_shift": True, "temperature_shift": 2.0},
}
SCENARIOS = {"clean": contract.SCENARIOS["clean"], "failure": contract.SCENARIOS["data_quality_failure"], "mixed": MIXED}
NUMERIC = [*contract.DRIFT_FEATURES["numerical"], *contract.DRIFT_FEATURES["binary"]]
CATEGORICAL = contract.DRIFT_FEATURES["categorical"]


@pytest.fixture(scope="module")
def halves(sales):
    return [settle(sales.where(F.col("month") <= 3)), settle(sales.where(F.col("month") == 7))]


def counted(cells, column):
    found = cells.groupBy("feature", "number", "category").agg(F.sum(column).alias("n")).where("n > 0")
    return {tuple(r) for r in found.collect()}


def test_cells_equal_each_scenario_by_itself(halves):
    current = halves[1]
    sides = {name: f"n_{i}" for i, name in enumerate(SCENARIOS)}
    cells = settle(inject.scenario_cells(current, NUMERIC, CATEGORICAL, SCENARIOS, sides))
    for name, settings in SCENARIOS.items():
        alone = inject.plain_cells(inject.apply_scenario(current, settings), NUMERIC, CATEGORICAL, {"n": 1})
        assert counted(cells, sides[name]) == counted(alone, "n")
    # Columns that no scenario touches share one cell per row.
    assert cells.where(F.col("feature") == "month").count() == current.count()


def test_scenarios_score_as_they_do_alone(halves):
    reference, current = halves
    together = {(r["scenario"], r["feature"]): r for r in drift.drift_by_scenario(reference, current, SCENARIOS).collect()}
    assert len(together) == 3 * 10
    for name in ("clean", "mixed"):
        for r in drift.drift_by_column(reference, inject.apply_scenario(current, SCENARIOS[name])).collect():
            other = together[name, r["feature"]]
            assert other["score"] == pytest.approx(r["score"], rel=1e-9, abs=1e-12) and other["drifted"] == r["drifted"]


def test_each_side_is_read_once(spark, halves):
    """The plan of the counted cells scans each table once, whatever the number of scenarios."""
    reference, current = halves
    sides = {name: f"n_{i}" for i, name in enumerate(contract.SCENARIOS)}
    cells = drift.scenario_cell_table(reference, current, contract.SCENARIOS, contract.DRIFT_FEATURES, sides, 42, None)
    plan = cells.groupBy("feature", "number", "category").agg(*[F.sum(s) for s in sides.values()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert plan.count("partial_sum") == len(sides) and plan.index("Exchange hashpartitioning(feature") < plan.index("partial_sum")


def test_values_that_are_not_finite_count_as_missing(spark):
    rows = [(float(i),) for i in range(50)]
    clean = spark.createDataFrame(rows, "v double")
    odd = spark.createDataFrame([*rows, (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    found = drift.numeric_distances(clean, odd, ["v"]).first()
    assert (found["n_ref"], found["n_cur"], found["ks"], found["wasserstein"]) == (50, 50, 0.0, 0.0)
