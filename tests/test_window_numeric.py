"""Numeric drift and fingerprints per window: stream against batch, bounds against the exact distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sluicegate.operators import drift
from sluicegate.operators import fingerprint as fp
from sluicegate.session import shared_dir
from sluicegate.streaming.monitor import latest_windows, update_files
from sluicegate.streaming.numeric import BINS, binned_windows, fit_bins, numeric_window_drift, window_fingerprints
from workload import tables
from workload.tables import table

SMALL = "/root/testdata/sf0.001"
ONSET = "2024-01-10"


def sides(spark):
    events = table(spark, SMALL, "events").withColumn("user", F.col("user_id").cast("double"))
    return events.where(F.col("ts") < F.to_timestamp(F.lit(ONSET))), events


def rows(df, keys):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=lambda r: [str(r[i]) for i in range(keys)])


def test_streamed_windows_equal_their_batch_form(spark):
    reference, events = sides(spark)
    bins = fit_bins(reference, ["value", "user"])
    batch = binned_windows(events, "ts", "1 day", bins)
    source = tables.stream(spark, SMALL, "events").withColumn("user", F.col("user_id").cast("double"))
    streamed = binned_windows(source, "ts", "1 day", bins, "1 hour")
    path = shared_dir(spark)
    update_files(streamed, path, shared_dir(spark)).awaitTermination()
    found = latest_windows(spark, path, streamed.schema, ["window_start", "feature", "bin"])
    assert rows(found, 3) == rows(batch, 3)
    assert rows(numeric_window_drift(found, bins), 2) == rows(numeric_window_drift(batch, bins), 2)
    # The state of a window is bounded by features and bins.
    assert batch.groupBy("window_start").count().agg(F.max("count")).first()[0] <= 2 * (BINS + 2)


def test_distances_lie_within_their_bounds(spark):
    reference, events = sides(spark)
    odd = events.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") * 5 - 30).otherwise(F.col("value")))
    bins = fit_bins(reference, ["value", "user"], 8)
    found = numeric_window_drift(binned_windows(odd, "ts", "1 day", bins), bins).collect()
    every = odd.select("value", "user", F.date_trunc("day", "ts").alias("day")).collect()
    before = {name: np.sort([r[name] for r in reference.collect() if r[name] is not None]) for name in ("value", "user")}
    assert len(found) == 2 * len({r["day"] for r in every})
    for r in found:
        x = before[r["feature"]]
        y = np.sort([v[r["feature"]] for v in every if v["day"] == r["window_start"] and v[r["feature"]] is not None])
        points = np.unique(np.concatenate([x, y]))
        gap = np.abs(np.searchsorted(x, points, "right") / len(x) - np.searchsorted(y, points, "right") / len(y))
        area = float((gap[:-1] * np.diff(points)).sum()) / max(float(x.std()), 0.001)
        assert r["n_cur"] == len(y)
        assert r["ks"] - 1e-9 <= gap.max() <= r["ks_high"] + 1e-9
        assert r["wasserstein"] - 1e-9 <= area <= r["wasserstein_high"] + 1e-9


def test_bounds_meet_the_batch_operator_where_bins_are_fine(spark):
    reference, events = sides(spark)
    whole = events.withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    bins = fit_bins(reference, ["user"], 256)
    windowed = numeric_window_drift(binned_windows(whole, "ts", "1 day", bins), bins).first()
    exact = drift.numeric_distances(reference, whole, ["user"]).first()
    assert abs(windowed["ks"] - exact["ks"]) < 1e-9 and abs(windowed["wasserstein"] - exact["wasserstein"]) < 1e-9


def test_features_without_reference_values_have_no_bins(spark):
    reference, events = sides(spark)
    empty = reference.withColumn("value", F.lit(None).cast("double"))
    bins = fit_bins(empty, ["value", "user"], 4)
    assert set(bins.cuts) == {"user"}
    assert {r["feature"] for r in numeric_window_drift(binned_windows(events, "ts", "1 day", bins), bins).collect()} == {"user"}


def test_window_fingerprints_equal_those_of_their_rows(spark):
    events = table(spark, SMALL, "events")
    found = {r["window_start"]: (r["n_rows"], r["fingerprint"]) for r in window_fingerprints(events, "ts", "1 day").collect()}
    for day in sorted(found)[:3]:
        own = fp.fingerprint(events.where(F.date_trunc("day", "ts") == F.lit(day))).first()
        assert found[day] == (own["n_rows"], own["fingerprint"])
