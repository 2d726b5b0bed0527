"""Tumbling-window monitoring of a log, as one definition for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluicegate import contract
from sluicegate.functions.tails import chi_square_p
from sluicegate.operators.profile import null_cells
from sluicegate.session import settle

SIDE_COUNT = "n"
BATCH = "batch_no"


def window_stats(log: DataFrame, ts: str, width: str, by: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """(window_start, by..., n_rows, null_cells, missing_ratio, mean, min, max) per tumbling window.

    With ``watermark`` the state of a window is dropped once events that late can no longer come.
    """
    timed = log.withWatermark(ts, watermark) if watermark else log
    columns = log.columns
    one = timed.groupBy(F.window(ts, width).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        null_cells(log, columns).alias("null_cells"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    ratio = F.col("null_cells") / (F.col("n_rows") * F.lit(len(columns)))
    return one.select(F.col("w.start").alias("window_start"), *by, "n_rows", "null_cells", ratio.alias("missing_ratio"), "mean", "min", "max")


def category_windows(log: DataFrame, ts: str, width: str, category: str, watermark: str | None = None) -> DataFrame:
    """(window_start, category, n): the bounded state a windowed category drift needs."""
    timed = log.withWatermark(ts, watermark) if watermark else log
    one = timed.groupBy(F.window(ts, width).alias("w"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias(SIDE_COUNT))
    return one.select(F.col("w.start").alias("window_start"), "category", SIDE_COUNT)


def window_drift(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Chi-square per window of category counts against ``reference`` (category, n).

    Only categories that a window holds are joined: those it lacks add their expected counts, which
    are what is left of the window's total. A category that the reference lacks is drift.
    """
    total = reference.agg(F.sum(SIDE_COUNT).alias("total_ref"), F.count(F.lit(1)).alias("k_ref"))
    base = reference.select("category", F.col(SIDE_COUNT).alias("n_ref"))
    # One row of totals beside every window.
    met = counts.join(base, "category", "left").crossJoin(F.broadcast(total))
    seen = F.col("n_ref") > 0
    n = F.col(SIDE_COUNT)
    one = met.groupBy("window_start").agg(
        F.sum(n).alias("n_cur"),
        F.coalesce(F.sum(F.when(seen, n)), F.lit(0)).alias("n_seen"),
        F.coalesce(F.sum(F.when(seen, n * n * F.try_divide("total_ref", "n_ref"))), F.lit(0.0)).alias("squares"),
        (F.max("k_ref") + F.count_if(F.coalesce(~seen, F.lit(True))) - 1).alias("df"),
        F.coalesce(F.max("total_ref"), F.lit(0)).alias("total_ref"),
    )
    score = F.when(F.col("total_ref") > 0, F.greatest(F.lit(0.0), F.try_divide("squares", "n_cur") - 2 * F.col("n_seen") + F.col("n_cur")))
    scored = one.withColumn("score", score).withColumn("unseen", F.col("n_seen") < F.col("n_cur"))
    p = F.when(F.col("score").isNotNull(), F.when(F.col("unseen"), F.lit(0.0)).otherwise(chi_square_p(F.col("score"), F.col("df"))))
    return scored.withColumn("p_value", p).select(
        "window_start", "score", "df", "p_value", F.coalesce(F.col("p_value") < contract.SIGNIFICANCE, F.lit(True)).alias("drifted")
    )


def update_files(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every window that a micro-batch has changed, open ones included; a repeated batch overwrites itself."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        windows.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last state of each window that :func:`update_files` wrote."""
    rest = [c for c in schema.names if c not in keys]
    stored = spark.read.schema(T.StructType([*schema, T.StructField(BATCH, T.LongType())])).option("basePath", path).parquet(path)
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in schema.names])


def drift_stream(counts: DataFrame, reference: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finish the drift of each closed window per micro-batch; a repeated batch overwrites itself.

    The reference is stored before the stream starts.
    """
    base = settle(reference)

    def finish(batch: DataFrame, batch_id: int) -> None:
        window_drift(batch, base).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.foreachBatch(finish)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
