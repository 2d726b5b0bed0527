"""Requests of a stream are recorded once, and start a refit that the ledger holds."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sluicegate.operators import splits
from sluicegate.plans import experiment
from sluicegate.session import shared_dir
from sluicegate.streaming import retrain
from sluicegate.streaming.numeric import binned_windows, fit_bins


def log(spark):
    """Five days of numbers; they move on the third and the fifth."""
    rows = spark.range(5 * 240).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 360).alias("ts"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    return rows.withColumn("v", F.when(F.dayofmonth("ts").isin(3, 5), F.col("v") + 500).otherwise(F.col("v")))


def test_a_replayed_batch_adds_no_request(spark):
    events, path = log(spark), shared_dir(spark)
    bins = fit_bins(events.where("day(ts) = 1"), ["v"], 8)
    decisions = retrain.window_decisions(binned_windows(events, "ts", "1 day", bins), bins, [])
    first = retrain.record_requests(decisions.where("day(window_start) < 4"), "s", path, 0)
    assert [r["window_start"].day for r in first.collect()] == [3]
    assert retrain.record_requests(decisions.where("day(window_start) < 4"), "s", path, 0).count() == 1
    second = retrain.record_requests(decisions, "s", path, 1)
    assert [r["window_start"].day for r in second.collect()] == [5]
    assert sorted(r["window_start"].day for r in retrain.read_requests(spark, path).collect()) == [3, 5]
    assert retrain.record_requests(decisions, "other", path, 2).count() == 2


def test_a_closed_window_starts_one_refit(spark, sales):
    events, source, path, ledger = log(spark), shared_dir(spark), shared_dir(spark), shared_dir(spark)
    events.coalesce(1).write.parquet(source)
    bins = fit_bins(events.where("day(ts) = 1"), ["v"], 8)
    split = splits.chronological_split(sales, "1999-06-30", "2000-06-30", "2001-12-31")
    called = []

    def refit(requests):
        called.append(sorted(r["window_start"] for r in requests.collect()))
        experiment.run_matrix(split, "retrain", [("proposed", "proposed", "")], [42], 1, ledger, maxIter=1, maxDepth=2)

    for _ in range(2):  # the second stream starts anew, as after a lost checkpoint
        stream = binned_windows(spark.readStream.schema(events.schema).parquet(source), "ts", "1 day", bins, "1 hour")
        retrain.retrain_stream(stream, bins, "s", path, shared_dir(spark), refit, []).awaitTermination()
    third = datetime.datetime(2024, 1, 3)
    # The fifth day is still open.
    assert [r["window_start"] for r in retrain.read_requests(spark, path).collect()] == [third]
    assert called and all(c == [third] for c in called)
    assert experiment.read_ledger(spark, ledger).select("config_hash").distinct().count() == 1
