"""Order-dependent results without a one-task window.

The order is cut into buckets. A tiny table holds what each bucket must know about the ones before
it, and the rows themselves are only ever sorted within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.session import settle

BUCKET = "__bucket"
MIN_BUCKETS = 16
ROWS_PER_BUCKET = 1_000_000
SKETCH_GROUPS = 64
SKETCH_SIZE = 4096
CUTS = "feature string, cuts array<double>"


def unpivot_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) with NULLs dropped and values as doubles."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(*(keep or []), F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def stored_counts(values: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Counts per distinct value, written to shared storage: whatever made the values runs once, and
    cut points and prefix sums read the counts."""
    return settle(values.groupBy(*keys).agg(*aggregates))


def fit_cuts(values: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Cut points per feature from a quantile sketch: a local table (feature, cuts).

    The number of buckets follows the number of rows. The cuts only balance the
    sorting, and an approximate sketch is enough. They are fixed before the plan that uses them: a
    recomputed task sees the same buckets. Sketches are merged in two steps, and the driver receives
    one sketch of bounded size per feature.
    """
    sketched = (
        values.groupBy("feature", F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part"))
        .agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch"))
        .groupBy("feature")
        .agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    )
    sketches = sketched.select("feature", "sketch", F.kll_sketch_get_n_double("sketch").alias("n")).collect()
    if not sketches:
        return values.sparkSession.createDataFrame([], CUTS)
    wanted = max(r["n"] for r in sketches) // rows_per_bucket
    buckets = max(MIN_BUCKETS, wanted)
    ranks = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    local = values.sparkSession.createDataFrame(sketches, "feature string, sketch binary, n bigint")
    cuts = local.select("feature", F.expr(f"kll_sketch_get_quantile_double(sketch, array({ranks})) AS cuts")).collect()
    return values.sparkSession.createDataFrame(cuts, CUTS)


def bucket_of(value: Column, cuts: Column) -> Column:
    """Number of cuts below ``value``, by binary search; positions past the end count as above it."""
    highest = F.floor(F.log2(F.greatest(F.size(cuts), F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(F.lit(0))
    )


def with_buckets(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add the bucket column. ``cuts`` is local: one number per feature and ROWS_PER_BUCKET distinct values."""
    joined = df.join(cuts, "feature", "left")
    return joined.withColumn(BUCKET, bucket_of(F.col("value"), F.col("cuts"))).drop("cuts")


def prefix_sums(df: DataFrame, keys: list[str], order: str, weights: list[str]) -> DataFrame:
    """Add, per weight ``w``, ``before_w`` (sum over all earlier rows of the key) and ``total_w``,
    and add ``next_order``, the following row's order value.

    ``df`` carries BUCKET, a number that rises with ``order``. The carried table has one row per key
    and bucket.
    """
    per_bucket = df.groupBy(*keys, BUCKET).agg(
        *[F.sum(w).alias(f"__sum_{w}") for w in weights], F.min(order).alias("__first")
    )
    along = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = per_bucket.select(
        *keys,
        BUCKET,
        F.lead("__first").over(along).alias("__next_first"),
        *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), F.lit(0)).alias(f"__offset_{w}") for w in weights],
        *[F.sum(f"__sum_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    inside_earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = df.join(carried, [*keys, BUCKET]).withColumns(
        {
            **{
                f"before_{w}": F.coalesce(F.sum(w).over(inside_earlier), F.lit(0)) + F.col(f"__offset_{w}")
                for w in weights
            },
            "next_order": F.coalesce(F.lead(order).over(inside), F.col("__next_first")),
        }
    )
    return summed.drop("__next_first", *[f"__offset_{w}" for w in weights])


def range_counts(values: DataFrame) -> DataFrame:
    """(feature, value, n, BUCKET) of distinct values, in stored key ranges over (feature, value).

    A range is a partition of about equally many values: many small features share one and a large one has
    several, so any number of features is cut. Ranges are stored with their numbers, so a task that is computed
    again cannot see others.
    """
    counts = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return settle(counts.repartitionByRange("feature", "value").withColumn(BUCKET, F.spark_partition_id()))


def quantiles_of(values: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles of (feature, value) rows: (feature, n, q_0, q_1, ...).

    Works on counts per distinct value with ranks within key ranges, so no task holds a whole feature, and
    nothing of a feature passes through the driver: there may be as many features as rows.
    """
    ranked = prefix_sums(range_counts(values), ["feature"], "value", ["n"])
    found = []
    for i, p in enumerate(probabilities):
        position = (F.col("total_n") - 1) * F.lit(float(p))
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            holds = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
            found.append(F.max(F.when(holds, F.col("value"))).alias(f"{side}_{i}"))
    one = ranked.groupBy("feature").agg(F.max("total_n").alias("n"), *found)
    out = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        out.append((F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * share).alias(f"q_{i}"))
    return one.select("feature", "n", *out)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """:func:`quantiles_of` the named columns, NULLs left out."""
    return quantiles_of(unpivot_values(df, columns), probabilities)


def lag_in_order(
    df: DataFrame,
    value: str,
    order: str,
    alias: str,
    keys: list[str] | None = None,
    first: float = 0.0,
    bucket: Column | None = None,
) -> DataFrame:
    """Add the previous existing row's ``value`` along the timestamp ``order``; ``first`` where there is
    none. Times are unique within their key.

    Rows are sorted within time buckets, and the last value of each bucket is carried to the next one
    that exists. By default buckets hold about equally many rows, so a busy hour is divided further.
    ``bucket`` may name a fixed one that rises with time, such as the year of a daily table.
    """
    keys = keys or []
    if bucket is None:
        at = F.unix_micros(order).cast("double")
        timed = df.where(F.col(order).isNotNull()).select(F.lit("time").alias("feature"), at.alias("value"))
        found = fit_cuts(timed).first()
        points = F.array(*[F.lit(c) for c in found["cuts"]] if found else []).cast("array<double>")
        bucketed = df.withColumn(BUCKET, bucket_of(at, points))
    else:
        bucketed = df.withColumn(BUCKET, bucket)
    tails = bucketed.groupBy(*keys, BUCKET).agg(F.max_by(value, order).alias("__tail"))
    along = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(BUCKET)
    carried = tails.select(*keys, BUCKET, F.lag("__tail").over(along).alias("__carried"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    same = [bucketed[c].eqNullSafe(carried[c]) for c in [*keys, BUCKET]]
    joined = bucketed.join(carried, same, "left").drop(*[carried[c] for c in [*keys, BUCKET]])
    previous = F.when(F.row_number().over(inside) == 1, F.col("__carried")).otherwise(F.lag(value).over(inside))
    return joined.withColumn(alias, F.coalesce(previous, F.lit(first))).select(*df.columns, alias)
