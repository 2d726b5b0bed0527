from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import fingerprint as fp
from sluicegate.operators import rules
from sluicegate.session import shared_dir
from sluicegate.sources import adapters, io, prediction_log
from sluicegate.streaming import requests
from sluicegate.streaming.monitor import window_stats


def test_hourly_adapter(spark, tmp_path):
    path = tmp_path / "hour.csv"
    path.write_text("dteday,hr,season,holiday,temp,weekday,mnth,cnt\n2011-01-01,1,1,0,0.22,6,1,12\n2011-01-01,0,1,0,0.24,6,1,10\n")
    raw = spark.read.schema("dteday string, hr int, season int, holiday int, temp double, weekday int, mnth int, cnt int").csv(str(path), header=True)
    out = adapters.adapt_hourly(raw, "dteday", "hr", "season", "holiday", "temp", "cnt")
    assert out.columns == contract.SALES_COLUMNS
    rows = out.orderBy("date").collect()
    assert [r["sales_demand"] for r in rows] == [10.0, 12.0]
    assert [r["previous_day_sales"] for r in rows] == [0.0, 10.0]
    assert rows[0]["day_of_week"] == 5


def test_transaction_adapter(spark):
    day = datetime.datetime
    rows = [
        (day(2024, 1, 1, 9), "A", 2, 3.0),
        (day(2024, 1, 1, 17), "A", 1, 5.0),
        (day(2024, 1, 5), "A", 1, 7.0),
        (day(2024, 1, 1), "A", -1, 5.0),
        (day(2024, 1, 1), "B", 1, 0.0),
        (day(2024, 1, 2), None, 1, 1.0),
    ]
    raw = spark.createDataFrame(rows, "at timestamp, country string, quantity int, unit_price double")
    out = adapters.adapt_transactions(raw, "at", "country", "quantity", "unit_price").orderBy("date").collect()
    assert [(r["store_id"], r["sales_demand"], r["price"], r["inventory_level"], r["previous_day_sales"]) for r in out] == [
        ("A", 11.0, 4.0, 3.0, 0.0),
        ("A", 7.0, 7.0, 1.0, 11.0),
    ]


@pytest.mark.parametrize("suffix", [".parquet", ".csv"])
def test_save_and_verified_load(spark, sales, suffix):
    path = shared_dir(spark) + suffix
    saved = io.save_dataset(sales, path).first()
    loaded = io.load_dataset(spark, path, expected=saved["fingerprint"])
    assert loaded.count() == saved["n_rows"]
    with pytest.raises(ValueError, match="mismatch"):
        io.load_dataset(spark, path, expected="0" * 64)


def test_load_errors(spark):
    with pytest.raises(ValueError, match="unsupported"):
        io.load_dataset(spark, "/tmp/data.txt")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.load_dataset(spark, "/tmp/no-such-table.parquet")


def test_reports_and_result_tables(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    path = shared_dir(spark)
    io.save_result_table(df, path + "/csv")
    assert spark.read.csv(path + "/csv", header=True).columns == ["a", "b"]
    io.save_report(df, path + "/json")
    assert spark.read.schema(df.schema).json(path + "/json").first() == df.first()


def test_file_fingerprints(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = fp.file_fingerprints(spark, str(tmp_path)).first()
    assert row["fingerprint"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_prediction_log(spark, tmp_path):
    assert prediction_log.load_predictions(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "log"
    os.makedirs(folder)
    lines = [json.dumps({"timestamp": f"2024-01-0{d}T00:00:00", "request_id": str(d), "prediction": d / 3}) for d in (1, 2, 3)]
    (folder / "old.json").write_text("\n\n".join(lines) + "\n")
    new = spark.createDataFrame([("n", 1.0)], "request_id string, prediction double")
    for c in prediction_log.LOG_SCHEMA:
        if c.name not in new.columns:
            new = new.withColumn(c.name, F.lit(None).cast(c.dataType))
    prediction_log.append_predictions(new.withColumn("timestamp", F.lit("2024-01-03").cast("timestamp")), str(folder))
    assert prediction_log.load_predictions(spark, str(folder)).count() == 4
    ranged = prediction_log.load_predictions(spark, str(folder), "2024-01-02", "2024-01-03")
    assert ranged.count() == 3
    (folder / "bad.json").write_text('{"request_id": "x", \n{"prediction": "no number"}\n\n{"request_id": "fine"}\n')
    assert prediction_log.load_predictions(spark, str(folder)).count() == 5
    bad = {r["line"] for r in prediction_log.corrupt_lines(spark, str(folder)).collect()}
    assert bad == {'{"request_id": "x", ', '{"prediction": "no number"}'}


def test_ranges_of_a_log_are_partition_filters(spark):
    path = shared_dir(spark)
    log = spark.range(96).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600 + 0.000001).alias("ts"), F.col("id"))
    prediction_log.append_log(log, path, "ts")
    prediction_log.append_log(log.where("id = 1").withColumn("ts", F.lit(None).cast("timestamp")), path, "ts")
    good, bad = prediction_log.read_log(spark, path, log.schema, "ts", "2024-01-02", "2024-01-03 05:00:00")
    assert {tuple(r) for r in good.collect()} == {tuple(r) for r in log.where("id BETWEEN 24 AND 52").collect()} and bad.count() == 0
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_day" in plan and "(log_day#" in plan
    assert prediction_log.read_log(spark, path, log.schema, "ts")[0].count() == 97


def test_stream_equals_batch(spark, sales):
    source, out = shared_dir(spark), shared_dir(spark)
    events = sales.withColumn("price", F.when(F.col("month") == 3, -1.0).otherwise(F.col("price")))
    events.repartition(4).write.parquet(source)
    stream = requests.read_files(spark, source, events.schema, per_trigger=1)
    requests.quarantine_stream(stream, rules.request_rules(), out, shared_dir(spark)).awaitTermination()
    got = spark.read.parquet(out)
    good, bad = rules.quarantine(events, rules.request_rules())
    assert got.where("verdict = 'accepted'").select(*events.columns).exceptAll(good).count() == 0
    assert got.where("verdict = 'rejected'").count() == bad.count() > 0


def test_windows_of_a_stream_equal_those_of_a_batch(spark):
    source, out = shared_dir(spark), shared_dir(spark)
    log = spark.range(4000).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 300).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("v")
    )
    log.repartitionByRange(4, "ts").write.parquet(source)
    batch = window_stats(log, "ts", "1 day", ["kind"], "v")
    stream = window_stats(requests.read_files(spark, source, log.schema), "ts", "1 day", ["kind"], "v", watermark="1 hour")
    requests.append_files(stream, out, shared_dir(spark)).awaitTermination()
    got = spark.read.schema(batch.schema).parquet(out)
    last = log.agg(F.date_trunc("day", F.max("ts") - F.expr("INTERVAL 1 HOUR"))).first()[0]
    assert got.exceptAll(batch).count() == 0
    assert got.count() == batch.where(F.col("window_start") < F.lit(last)).count()
