"""Retraining requests from closed windows of a stream, each recorded once, and the refit they start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.operators.drift import drift_decision, drift_summary, retrain_requests
from sluicegate.session import settle
from sluicegate.streaming.numeric import FixedBins, numeric_window_drift

BATCH = "batch_no"
REQUEST = (
    "scenario string, window_start timestamp, drift_share double, drifted_columns array<string>, "
    "reason string, status string, auto_trigger boolean"
)
KEYS = ["scenario", "window_start"]


def window_decisions(windows: DataFrame, bins: FixedBins, critical: list[str] | None = None) -> DataFrame:
    """The decision per window from the numeric features that its KS test says have drifted."""
    scored = numeric_window_drift(windows, bins).withColumnRenamed("ks_drifted", "drifted")
    return drift_decision(drift_summary(scored, ["window_start"]), critical)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The recorded requests with the number of the batch that added them; none yet is an empty table."""
    try:
        return spark.read.schema(f"{REQUEST}, {BATCH} long").option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{REQUEST}, {BATCH} long")


def record_requests(decisions: DataFrame, scenario: str, path: str, batch: int, auto_trigger: bool = False) -> DataFrame:
    """Record the requests of one batch's decisions and return those that no other batch has recorded.

    A batch has a folder of its own, which a replay writes again with the same rows; a window that an earlier batch
    has asked for is not asked for again.
    """
    spark = decisions.sparkSession
    wanted = retrain_requests(decisions.withColumn("scenario", F.lit(scenario)), KEYS, auto_trigger)
    earlier = read_requests(spark, path).where(F.col(BATCH) != batch).select(*KEYS)
    fresh = settle(wanted.join(earlier, KEYS, "left_anti"))
    fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")
    return fresh


def retrain_stream(
    windows: DataFrame, bins: FixedBins, scenario: str, path: str, checkpoint: str, refit: Callable[[DataFrame], None] | None = None, critical: list[str] | None = None
) -> StreamingQuery:
    """Decide on every closed window of a binned stream, record its request, and start ``refit`` on new ones.

    ``windows`` is a watermarked stream of :func:`binned_windows`; in append mode a window comes once, whole, when it
    is closed. ``refit`` takes the new requests; it is called again when a batch is replayed, so it should be keyed by
    what it does, as a run matrix with a ledger is: that finds its run done and fits nothing.
    """

    def decide(batch: DataFrame, number: int) -> None:
        held = settle(batch)
        fresh = record_requests(window_decisions(held, bins, critical), scenario, path, number, refit is not None)
        if refit is not None and not fresh.isEmpty():
            refit(fresh)

    return (
        windows.writeStream.foreachBatch(decide)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
