from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluicegate.operators import fingerprint as fp
from sluicegate.operators import inject, ordered, splits


def digest(df, **options):
    return fp.fingerprint(df, **options).first()["fingerprint"]


def test_fingerprint_ignores_order_and_partitions(sales):
    assert digest(sales) == digest(sales.select(*reversed(sales.columns)).repartition(5))


def test_fingerprint_sees_one_cell_and_one_copy(sales):
    base = digest(sales)
    assert digest(sales.unionByName(sales.orderBy("price", "date", "inventory_level").limit(1))) != base
    top = sales.agg(F.max("previous_day_sales")).first()[0]
    moved = sales.withColumn("price", F.when(F.col("previous_day_sales") == top, F.col("price") + 1e-9).otherwise(F.col("price")))
    assert digest(moved) != base


def test_a_pair_of_copies_does_not_cancel(spark):
    one = spark.createDataFrame([(1,)], "a int")
    assert len({digest(one), digest(one.union(one)), digest(one.union(one).union(one)), digest(one.limit(0))}) == 4


def test_cells_cannot_be_confused(spark):
    a = spark.createDataFrame([("x|b:1:y", None)], "a string, b string")
    b = spark.createDataFrame([("x", "y")], "a string, b string")
    c = spark.createDataFrame([("x", "~")], "a string, b string")
    d = spark.createDataFrame([("x", None)], "a string, b string")
    assert len({digest(t) for t in (a, b, c, d)}) == 4


def test_declared_order_and_vector_order_matter(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "i int, v double")
    assert digest(df, keep_column_order=True) != digest(df.select("v", "i"), keep_column_order=True)
    swapped = spark.createDataFrame([(1, 3.0), (2, 2.0)], "i int, v double")
    assert fp.vector_fingerprint(df, "i", "v").first()["fingerprint"] != fp.vector_fingerprint(swapped, "i", "v").first()["fingerprint"]


def test_verify(sales):
    assert fp.verify(sales, digest(sales)).first()["matches"]
    assert not fp.verify(sales, "0" * 64).first()["matches"]


def test_bucketed_prefix_sums_equal_the_plain_window(spark):
    values = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("feature"),
        F.when(F.col("id") % 3 == 1, F.lit(7.0)).otherwise((F.xxhash64("id") % 500).cast("double")).alias("value"),
    )
    counts = ordered.stored_counts(values, ["feature", "value"], [F.count(F.lit(1)).alias("n")])
    got = ordered.prefix_sums(ordered.with_buckets(counts, ordered.fit_cuts(counts, 20)), ["feature"], "value", ["n"])
    along = Window.partitionBy("feature").orderBy("value")
    want = counts.select(
        "feature",
        "value",
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_n"),
        F.sum("n").over(Window.partitionBy("feature")).alias("total_n"),
        F.lead("value").over(along).alias("next_order"),
    )
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    data = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    one = ordered.exact_quantiles(df, ["v"], [0.0, 0.5, 0.95, 1.0]).first()
    assert [one[f"q_{i}"] for i in range(4)] == pytest.approx(np.quantile(data, [0.0, 0.5, 0.95, 1.0]).tolist())


@pytest.mark.parametrize("bucket", ["sketch", "month"])
def test_lag_crosses_empty_buckets(spark, bucket):
    days = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), datetime.datetime(2024, 5, 1), datetime.datetime(2024, 5, 9)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "at timestamp, v double")
    fixed = F.date_trunc("month", "at") if bucket == "month" else None
    got = ordered.lag_in_order(df, "v", "at", "prev", bucket=fixed).orderBy("at").collect()
    assert [r["prev"] for r in got] == [0.0, 0.0, 1.0, 2.0]


def test_chronological_ends_are_inclusive(spark):
    rows = [(datetime.datetime(2024, 1, d) if d else None,) for d in (1, 2, 3, 4, 0)]
    df = splits.chronological_split(spark.createDataFrame(rows, "date timestamp"), "2024-01-01", "2024-01-02", "2024-01-03")
    assert [r["split"] for r in df.orderBy(F.col("date").asc_nulls_last()).collect()] == ["train", "validation", "test", None, None]


def test_positional_split_divides_a_day_of_equal_rows(spark):
    """A third of all rows are copies of one row, and both boundaries fall into their day."""
    hot = spark.range(900).select(F.lit(datetime.datetime(2024, 1, 2)).alias("date"), F.lit(1.0).alias("v"))
    early = spark.range(50).select(F.lit(datetime.datetime(2024, 1, 1)).alias("date"), F.col("id").cast("double").alias("v"))
    late = spark.range(50).select(F.lit(None).cast("timestamp").alias("date"), F.col("id").cast("double").alias("v"))
    df = hot.unionByName(early).unionByName(late)
    cut = splits.positional_split(df)
    sizes = {r["split"]: r["count"] for r in cut.groupBy("split").count().collect()}
    assert sizes == {"train": 700, "validation": 150, "test": 150}
    assert cut.drop("split").exceptAll(df).count() == 0
    assert cut.where("date IS NULL AND split <> 'test'").count() == 0


def test_injection_does_not_depend_on_partitioning(sales):
    a = inject.apply_scenario(sales.repartition(3), "data_quality_failure")
    b = inject.apply_scenario(sales.repartition(8), "data_quality_failure")
    assert digest(a) == digest(b)
    assert digest(inject.apply_scenario(sales, "data_quality_failure", seed=7)) != digest(a)


def test_injection_hits_about_the_asked_share(sales):
    n = sales.count()
    bad = inject.apply_scenario(sales, "data_quality_failure")
    one = bad.agg(F.count(F.lit(1)), F.count_if(F.col("price") < 0), F.count_if(F.col("price").isNull()), F.count_if(F.col("date").isNull())).first()
    assert one[0] / n == pytest.approx(1.05, abs=0.02)
    assert one[1] / n == pytest.approx(0.084, abs=0.02)
    assert one[2] / n == pytest.approx(0.05, abs=0.02)
    assert 20 < one[3] < 90


def test_price_shift(sales):
    moved = inject.apply_scenario(sales, {"faults": {}, "drift": {"price_shift_factor": 1.5}})
    assert moved.agg(F.avg("price")).first()[0] > 1.3 * sales.agg(F.avg("price")).first()[0]


def test_clean_scenario_changes_nothing(sales):
    assert digest(inject.apply_scenario(sales, "clean")) == digest(sales)
