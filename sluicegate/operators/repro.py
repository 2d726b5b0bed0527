"""Differences between two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators.fingerprint import fingerprint
from sluicegate.session import settle

#: Hash buckets that are compared before rows are; a table of one number each is sent to all tasks.
DIFF_BUCKETS = 4096
#: Copies that one step of a row's expansion makes.
COPIES = 10_000


def metric_diff(run1: DataFrame, run2: DataFrame, by: list[str] | None = None, tolerance: dict | None = None) -> DataFrame:
    """Metric by metric, led by the first run: (by..., metric, run1, run2, diff, tolerance, matches).

    A metric the second run lacks does not match; one that only it has is ignored.
    """
    keys = [*(by or []), "metric"]
    limits = contract.METRIC_TOLERANCE if tolerance is None else tolerance
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))]) if limits else None
    allowed = F.lit(contract.DEFAULT_TOLERANCE)
    if table is not None:
        allowed = F.coalesce(F.try_element_at(table, F.col("metric")), allowed)
    left = run1.select(*keys, F.col("value").alias("run1"))
    right = run2.select(*keys, F.col("value").alias("run2"))
    joined = left.join(right, keys, "left").withColumn("diff", F.abs(F.col("run1") - F.col("run2")))
    near = joined.withColumn("tolerance", allowed)
    same = (F.col("diff") <= F.col("tolerance")) & ~F.isnan("diff")
    return near.select(*keys, "run1", "run2", "diff", "tolerance", F.coalesce(same, F.lit(False)).alias("matches"))


def prediction_diff(
    run1: DataFrame, run2: DataFrame, key: list[str], tolerance: float = contract.PREDICTION_TOLERANCE
) -> DataFrame:
    """(n_run1, n_run2, n_matched, max_diff, mean_diff, matches) over predictions joined on their row key.

    Rows that repeat a key are paired in the order of their predictions. A row that only one run has is a
    shape mismatch.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("prediction")).alias("__nth")
    left = run1.select(*key, nth, F.col("prediction").alias("p1"), F.lit(1).alias("in1"))
    right = run2.select(*key, nth, F.col("prediction").alias("p2"), F.lit(1).alias("in2"))
    gap = F.abs(F.col("p1") - F.col("p2"))
    one = left.join(right, [*key, "__nth"], "full").agg(
        F.count("in1").alias("n_run1"),
        F.count("in2").alias("n_run2"),
        F.count(gap).alias("n_matched"),
        F.max(gap).alias("max_diff"),
        F.avg(gap).alias("mean_diff"),
    )
    shape = (F.col("n_run1") == F.col("n_run2")) & (F.col("n_matched") == F.col("n_run1"))
    within = F.coalesce(F.col("max_diff") <= tolerance, F.lit(True))
    return one.select("*", shape.alias("shape_matches"), (shape & within).alias("matches"))


def feature_diff(runs: DataFrame, features1: str, features2: str, by: list[str]) -> DataFrame:
    """Set comparison of two feature-name arrays per row."""
    missing = F.array_sort(F.array_except(features1, features2))
    extra = F.array_sort(F.array_except(features2, features1))
    return runs.select(
        *by,
        F.size(F.array_distinct(features1)).alias("run1_count"),
        F.size(F.array_distinct(features2)).alias("run2_count"),
        F.array_join(missing, ",").alias("missing_in_run2"),
        F.array_join(extra, ",").alias("extra_in_run2"),
        ((F.size(missing) == 0) & (F.size(extra) == 0)).alias("matches"),
    )


def repro_report(checks: dict[str, DataFrame], flag: str = "matches") -> DataFrame:
    """(check_name, passed, reproducible): each check's rows must all pass, and then all checks.

    Only the checks given are made; predictions, for example, may be left out.
    """
    parts = [
        df.agg(F.coalesce(F.bool_and(F.coalesce(flag, F.lit(False))), F.lit(True)).alias("passed")).select(
            F.lit(name).alias("check_name"), "passed"
        )
        for name, df in checks.items()
    ]
    table = reduce(DataFrame.unionByName, parts)
    overall = table.agg(F.bool_and("passed").alias("reproducible"))
    # One row per check against one row.
    return table.crossJoin(overall)


def _bucketed(df: DataFrame, types: dict, bucket: str, buckets: int) -> DataFrame:
    """``df`` in the types that both sides share, with the hash bucket of each row."""
    typed = df.select(*[df[f"`{c}`"].cast(t).alias(c) for c, t in types.items()])
    return typed.withColumn(bucket, F.pmod(F.xxhash64(*[f"`{c}`" for c in types]), F.lit(buckets)).cast("int"))


def differing_buckets(left: DataFrame, right: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """The buckets whose rows, copies counted, are not the same on both sides: a stored table."""
    one, two = (
        fingerprint(df, by=[bucket], columns=columns).select(bucket, F.col("fingerprint").alias(name))
        for df, name in ((left, "one"), (right, "two"))
    )
    return settle(one.join(two, bucket, "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(bucket))


def row_difference(left: DataFrame, right: DataFrame, buckets: int = DIFF_BUCKETS) -> DataFrame:
    """Rows (with multiplicity) of one table that the other lacks: (columns..., side).

    Each side is read for a fingerprint per hash bucket of its rows. Only rows of buckets that differ are then
    moved and counted against each other, so tables that are nearly the same shuffle next to nothing.
    ``right`` needs the columns of ``left``, in any order. No column may be called side.
    """
    columns = left.columns
    if "side" in columns:
        raise ValueError("a column called side hides the one that is added")
    quoted = [f"`{c}`" for c in columns]
    right = right.select(*quoted)
    types = {f.name: f.dataType for f in left.limit(0).union(right.limit(0)).schema.fields}
    bucket, net = (name + "_" * max(map(len, columns)) for name in ("__bucket", "__net"))  # longer than any column's
    one, two = (_bucketed(df, types, bucket, buckets) for df in (left, right))
    open_buckets = F.broadcast(differing_buckets(one, two, bucket, columns))  # at most ``buckets`` rows
    signed = [df.join(open_buckets, bucket, "left_semi").select(*quoted, F.lit(n).alias(net)) for df, n in ((one, 1), (two, -1))]
    counted = signed[0].unionAll(signed[1]).groupBy(*quoted).agg(F.sum(net).alias(net)).where(F.col(f"`{net}`") != 0)
    copies = F.abs(F.col(f"`{net}`"))
    side = F.when(F.col(f"`{net}`") > 0, "left").otherwise("right").alias("side")
    steps = counted.select(*quoted, side, copies.alias(net), F.explode(F.sequence(F.lit(0), F.floor((copies - 1) / COPIES))).alias(bucket))
    left_over = F.least(F.lit(COPIES).cast("bigint"), F.col(f"`{net}`") - F.col(f"`{bucket}`") * COPIES)
    return steps.select(*quoted, "side", F.explode(F.sequence(F.lit(1).cast("bigint"), left_over)).alias(net)).select(*quoted, "side")
