"""Leakage-free splits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.hashing import row_text
from sluicegate.operators.ordered import BUCKET, prefix_sums
from sluicegate.session import settle

SPLIT = "split"
NAMES = ("train", "validation", "test")
COPY_CHUNK = 1_000_000


def chronological_split(
    df: DataFrame, train_end: str, validation_end: str, test_end: str, date: str = contract.DATE
) -> DataFrame:
    """Add ``split``. The ends are inclusive; rows without a date or after the last end get NULL."""
    day = F.col(date)
    ends = [F.to_timestamp(F.lit(e)) for e in (train_end, validation_end, test_end)]
    label = F.when(day <= ends[0], NAMES[0]).when(day <= ends[1], NAMES[1]).when(day <= ends[2], NAMES[2])
    return df.withColumn(SPLIT, label)


def reference_rows(split_df: DataFrame) -> DataFrame:
    """The drift baseline: train and validation as one bag, in one scan."""
    return split_df.where(F.col(SPLIT).isin(*NAMES[:2])).drop(SPLIT)


def expand_copies(df: DataFrame, copies: str) -> DataFrame:
    """Repeat each row ``copies`` times, in chunks that are spread over the cluster first."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / COPY_CHUNK))
    chunked = df.where(F.col(copies) > 0).withColumn("__chunk", F.explode(chunks))
    left = F.least(F.lit(COPY_CHUNK), F.col(copies) - F.col("__chunk") * COPY_CHUNK).cast("int")
    spread = chunked.repartition(F.xxhash64("__chunk", *[c for c in df.columns if c != copies]))
    return spread.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), left))).drop("__copy", "__chunk", copies)


def positional_split(
    df: DataFrame, date: str = contract.DATE, fractions: tuple[float, float] = contract.SPLIT_FRACTIONS
) -> DataFrame:
    """Split by row position in date order: exact sizes int(n·f), rows without a date last.

    Days that lie wholly in one part are labelled from their position. Only the rows of the (at
    most two) days a boundary falls into are ranked: equal rows are first counted together, distinct
    rows are ranked by hash within hash buckets, and a boundary inside a group of equal rows
    divides its copies.
    """
    day = F.coalesce(F.unix_date(F.col(date).cast("date")), F.lit(2**31 - 1))
    keyed = df.withColumn("__day", day)
    per_day = keyed.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy(F.lit(0))
    running = everything.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__n").over(everything)
    days = per_day.select(
        "__day",
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__start"),
        "__n",
        *[F.floor(total * F.lit(float(f))).alias(f"__cut_{i}") for i, f in enumerate(fractions)],
    )
    start, end = F.col("__start"), F.col("__start") + F.col("__n")
    first, second = F.col("__cut_0"), F.col("__cut_1")
    label = (
        F.when(end <= first, NAMES[0])
        .when((start >= first) & (end <= second), NAMES[1])
        .when(start >= second, NAMES[2])
    )
    days = settle(days.withColumn(SPLIT, label))
    labelled = keyed.join(days, "__day")
    whole_days = labelled.where(F.col(SPLIT).isNotNull()).select(*df.columns, SPLIT)

    cut_days = labelled.where(F.col(SPLIT).isNull())
    position = ["__day", "__start", "__cut_0", "__cut_1"]
    distinct = cut_days.groupBy(*position, *df.columns).agg(F.count(F.lit(1)).alias("n"))
    digested = distinct.withColumn("__digest", F.sha2(row_text(df), 256))
    bucketed = digested.withColumn(BUCKET, F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    ranked = prefix_sums(bucketed, ["__day"], "__digest", ["n"])
    low = F.col("__start") + F.col("before_n")
    high = low + F.col("n")
    zero = F.lit(0).cast("bigint")
    in_train = F.greatest(zero, F.least(high, first) - low)
    in_test = F.greatest(zero, high - F.greatest(low, second))
    parts = F.array(
        *[
            F.struct(F.lit(name).alias(SPLIT), n.alias("__copies"))
            for name, n in zip(NAMES, (in_train, F.col("n") - in_train - in_test, in_test), strict=True)
        ]
    )
    cut_rows = expand_copies(ranked.select(*df.columns, F.inline(parts)), "__copies")
    return whole_days.unionByName(cut_rows)
