"""The drift monitor: reference and current tables in, decision and retraining requests out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators import drift
from sluicegate.session import settle


def scenario_decisions(
    reference: DataFrame, current: DataFrame, scenarios: dict, float_scale: int | None = None
) -> DataFrame:
    """Decisions for the current rows under each scenario, from one counted table for all of them."""
    by_column = drift.drift_by_scenario(reference, current, scenarios, float_scale=float_scale)
    return drift.drift_decision(drift.drift_summary(by_column, ["scenario"]))


def monitor(reference: DataFrame, current: DataFrame, scenario: str, features: dict | None = None, **tests) -> dict[str, DataFrame]:
    """Run the drift tests once and derive everything else from their one row per feature."""
    scored = drift.drift_by_column(reference, current, features, **tests).withColumn("scenario", F.lit(scenario))
    by_column = settle(scored)
    decisions = drift.drift_decision(drift.drift_summary(by_column, ["scenario"]))
    return {
        "by_column": by_column,
        "decision": decisions,
        "requests": drift.retrain_requests(decisions, ["scenario"]),
    }
