"""Numeric drift and fingerprints per window, as streaming aggregates of bounded state.

A window keeps counts and sums over cut points that are fixed on the reference, and the parts of its lane sums. At the
cuts both distribution functions are exact; between them the distances lie within a bound that is returned too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.tails import kolmogorov_p
from sluicegate.operators.drift import MIN_NORM
from sluicegate.operators.fingerprint import combine, lane_sums, lane_totals, with_digest
from sluicegate.operators.ordered import bucket_of, exact_quantiles

#: Bins between the reference's least and greatest value; a power of two, so that the quantiles' positions are exact.
BINS = 32
BIN_TABLE = "feature string, bin int, low double, high double, n_ref bigint, total_ref double, size_ref bigint, spread double, f_ref double, f_before double"


@dataclass(frozen=True)
class FixedBins:
    """Cut points per feature, and the reference's counts over them as a local table (features x bins rows)."""

    cuts: dict[str, list[float]]
    table: DataFrame


def _binned(df: DataFrame, cuts: dict[str, list[float]], keep: list) -> DataFrame:
    """(keep..., feature, value, bin): bin b holds values above ``b`` of the cuts."""
    cells = []
    for name, points in cuts.items():
        value = F.col(f"`{name}`").cast("double")
        listed = F.expr(f"array({', '.join(f'{p!r}D' for p in points)})")
        cells.append(F.struct(F.lit(name).alias("feature"), value.alias("value"), bucket_of(value, listed).alias("bin")))
    return df.select(*keep, F.inline(F.array(*cells))).where(F.col("value").isNotNull() & ~F.isnan("value"))


def fit_bins(reference: DataFrame, features: list[str], bins: int = BINS) -> FixedBins:
    """Quantiles of the reference as cut points, and the reference's own counts, sums and spread.

    The number of features must be small: only features x bins numbers pass through the driver. A feature without
    a value in the reference gets no bins and has no rows in the results.
    """
    found = exact_quantiles(reference, features, [i / bins for i in range(bins + 1)]).collect()
    cuts = {r["feature"]: sorted({r[f"q_{i}"] for i in range(bins + 1)}) for r in found}
    if not cuts:
        return FixedBins({}, reference.sparkSession.createDataFrame([], BIN_TABLE))
    rows = _binned(reference, cuts, [])
    counted = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()
    spreads = {r["feature"]: r["spread"] for r in rows.groupBy("feature").agg(F.stddev_pop("value").alias("spread")).collect()}
    held = {(r["feature"], r["bin"]): (r["n"], r["total"]) for r in counted}
    out = []
    for name, points in sorted(cuts.items()):
        size = sum(n for (f, _), (n, _) in held.items() if f == name)
        seen = 0
        for i, (low, high) in enumerate(zip([None, *points], [*points, None], strict=True)):
            n, total = held.get((name, i), (0, 0.0))
            out.append((name, i, low, high, n, total, size, spreads[name], (seen + n) / size, seen / size))
            seen += n
    return FixedBins(cuts, reference.sparkSession.createDataFrame(out, BIN_TABLE))


def binned_windows(log: DataFrame, ts: str, width: str, bins: FixedBins, watermark: str | None = None) -> DataFrame:
    """(window_start, feature, bin, n, total): the state of a window, features x bins rows whatever the log's size."""
    timed = log.withWatermark(ts, watermark) if watermark else log
    rows = _binned(timed, bins.cuts, [ts])
    one = rows.groupBy(F.window(ts, width).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return one.select(F.col("w.start").alias("window_start"), "feature", "bin", "n", "total")


def numeric_window_drift(
    windows: DataFrame, bins: FixedBins, alpha: float = contract.SIGNIFICANCE, threshold: float = contract.DISTANCE_THRESHOLD
) -> DataFrame:
    """KS and normed Wasserstein distance of every window to the reference, with upper bounds.

    (window_start, feature, n_cur, ks, ks_high, p_value, ks_drifted, wasserstein, wasserstein_high, wasserstein_drifted).
    The true distances lie in [ks, ks_high] and [wasserstein, wasserstein_high]; tests use the lower ends. Within a
    bin the integral of the difference is exact, as sums are kept; it falls short of the area only where the two
    functions cross. A window without a value of a feature has no row for it.
    """
    # The bins are features x bins rows of fixed size.
    grid = windows.select("window_start", "feature").distinct().join(F.broadcast(bins.table), "feature")
    full = grid.join(windows, ["window_start", "feature", "bin"], "left").fillna({"n": 0, "total": 0.0})
    whole = Window.partitionBy("window_start", "feature")
    until = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum("n").over(whole)
    placed = full.withColumns({"size": size, "f": F.sum("n").over(until) / size}).withColumn("f_start", F.col("f") - F.col("n") / F.col("size"))
    first, last = F.col("low").isNull(), F.col("high").isNull()
    inside = F.when(first, F.col("f")).otherwise(F.greatest(F.abs(F.col("f_ref") - F.col("f_start")), F.abs(F.col("f_before") - F.col("f"))))
    span = F.col("high") - F.col("low")
    left = (F.col("n") * F.col("high") - F.col("total")) / F.col("size")
    right = (F.col("total") - F.col("n") * F.col("low")) / F.col("size")
    own = (F.col("n_ref") * F.col("high") - F.col("total_ref")) / F.col("size_ref")
    signed = F.abs(span * (F.col("f_before") - F.col("f_start")) + own - left)
    tail = F.when(first, left).when(last, right)
    one = placed.groupBy("window_start", "feature").agg(
        F.max("size").alias("n_cur"),
        F.max("size_ref").alias("size_ref"),
        F.max(F.abs(F.col("f_ref") - F.col("f"))).alias("ks"),
        F.max(inside).alias("inside"),
        F.sum(F.coalesce(tail, signed)).alias("low_area"),
        F.sum(F.coalesce(tail, F.greatest(signed, span * inside))).alias("high_area"),
        F.greatest(F.max("spread"), F.lit(MIN_NORM)).alias("norm"),
    )
    distances = one.select(
        "window_start",
        "feature",
        "n_cur",
        "ks",
        F.greatest("ks", "inside").alias("ks_high"),
        kolmogorov_p(F.col("ks"), F.col("size_ref"), F.col("n_cur")).alias("p_value"),
        (F.col("low_area") / F.col("norm")).alias("wasserstein"),
        (F.col("high_area") / F.col("norm")).alias("wasserstein_high"),
    )
    return distances.withColumns({"ks_drifted": F.col("p_value") < alpha, "wasserstein_drifted": F.col("wasserstein") >= threshold})


def window_fingerprints(log: DataFrame, ts: str, width: str, watermark: str | None = None, float_scale: int | None = None) -> DataFrame:
    """(window_start, n_rows, fingerprint) per window; the state is the window's lane sums.

    A window's fingerprint equals that of a table of its rows, however the stream was cut into batches.
    """
    timed = log.withWatermark(ts, watermark) if watermark else log
    digested = with_digest(timed, log.columns, float_scale)
    one = digested.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *lane_sums())
    return one.select(F.col("w.start").alias("window_start"), "n_rows", combine(F.col("n_rows"), lane_totals()).alias("fingerprint"))
