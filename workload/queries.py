"""The registered queries: each takes (spark, sf_dir) and runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import (
    boosting,
    drift,
    features,
    gates,
    inject,
    ledger,
    metrics,
    ordered,
    profile,
    repro,
    resample,
    rules,
    splits,
)
from sluicegate.operators import fingerprint as fp
from sluicegate.operators import manifest as files
from sluicegate.plans import experiment, monitor, release
from sluicegate.schema import conform
from sluicegate.session import settle, shared_dir
from sluicegate.sources import adapters, io, prediction_log
from sluicegate.streaming import requests
from sluicegate.streaming.monitor import category_windows, latest_windows, update_files, window_stats
from sluicegate.streaming.monitor import window_drift as category_drift
from sluicegate.streaming.numeric import binned_windows, fit_bins, numeric_window_drift, window_fingerprints
from sluicegate.streaming.retrain import read_requests, retrain_stream
from workload import tables
from workload.tables import SCALE, sales, table

ONSET = "2024-01-10"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.apply_scenario(sales(spark, sf_dir), "data_quality_failure", float_scale=SCALE)


def by_date(df: DataFrame) -> DataFrame:
    return splits.chronological_split(df, tables.TRAIN_END, tables.VALIDATION_END, tables.TEST_END)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as both engines print them. They break exact ties differently, so ``digits`` is more than a tie has."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- validation and gates ---


@query
def validate_rules(spark, sf_dir):
    return rounded(rules.violation_counts(faulty(spark, sf_dir), rules.sales_rules()))


@query
def duplicate_ratio(spark, sf_dir):
    return rounded(gates.duplicate_summary(faulty(spark, sf_dir)))


@query
def quality_gate(spark, sf_dir):
    return rounded(gates.quality_gate(faulty(spark, sf_dir)))


@query
def validation_report(spark, sf_dir):
    clean = gates.validation_report(sales(spark, sf_dir), "clean", float_scale=SCALE)
    bad = gates.validation_report(faulty(spark, sf_dir), "data_quality_failure", float_scale=SCALE)
    return rounded(clean.unionByName(bad))


# --- row-level verdicts, loading, logs ---


def keyed_requests(spark, sf_dir):
    """Faulty sales as scoring requests, keyed by row digest and copy."""
    bad = inject.apply_scenario(sales(spark, sf_dir), "data_quality_failure", float_scale=SCALE, keep_keys=True)
    return bad.withColumnsRenamed({inject.KEY: "row_key", inject.COPY: "copy_no"})


@query
def violation_cases(spark, sf_dir):
    cases = rules.first_cases(keyed_requests(spark, sf_dir), rules.sales_rules(), ["row_key", "copy_no"])
    number = F.round(F.expr("try_cast(failure_case AS double)"), 6)
    return cases.withColumn("failure_case", F.coalesce(number.cast("decimal(18,6)").cast("string"), F.col("failure_case")))


@query
def quarantine(spark, sf_dir):
    good, bad = rules.quarantine(keyed_requests(spark, sf_dir), rules.sales_rules())
    accepted = good.select("row_key", "copy_no", F.lit("").alias("violations"), F.lit("accepted").alias("verdict"))
    rejected = bad.select("row_key", "copy_no", F.array_join("violations", ",").alias("violations"), F.lit("rejected").alias("verdict"))
    return accepted.unionByName(rejected)


#: Cells of a text file that do not convert: column, condition on the row, what stands there.
GARBLED = [
    ("price", "day_of_week = 6 AND month = 2", "n/a"),
    ("inventory_level", "day_of_week = 5 AND month = 3", "12 boxes"),
    ("date", "day_of_week = 0 AND month = 12", "soon"),
    ("promotion_flag", "day_of_week = 1 AND month = 1", "yes"),
]


def text_sales(spark, sf_dir):
    """The faulty table as a CSV file with some garbled cells, loaded with every cell as text."""
    garbled = {c: (condition, word) for c, condition, word in GARBLED}
    cells = [
        F.when(F.expr(garbled[c][0]), F.lit(garbled[c][1])).otherwise(F.col(c).cast("string")).alias(c) if c in garbled else F.col(c)
        for c in contract.SALES_COLUMNS
    ]
    path = f"{shared_dir(spark)}/sales.csv"
    io.save_dataset(faulty(spark, sf_dir).select(*cells), path)
    return io.load_text(spark, path)


@query
def validate_text(spark, sf_dir):
    """Rules on text: a cell that does not convert breaks its type rule, and no other is asked of it."""
    return rounded(rules.violation_counts(text_sales(spark, sf_dir), rules.sales_rules()))


@query
def conform_text(spark, sf_dir):
    """The same file typed: cells that do not convert are missing, all others equal those of the table."""
    return fp.fingerprint(conform(text_sales(spark, sf_dir)), float_scale=SCALE).select("n_rows", "fingerprint")


@query
def load_saved(spark, sf_dir):
    """A dataset saved, verified on load by the fingerprint of what was written, and described again."""
    path = f"{shared_dir(spark)}/sales.parquet"
    written = io.save_dataset(sales(spark, sf_dir), path).first()["fingerprint"]
    return io.lineage(io.load_dataset(spark, path, expected=written), "sales", SCALE)


@query
def saved_report(spark, sf_dir):
    """The rule counts as a JSON report, read back."""
    counts = rounded(rules.violation_counts(faulty(spark, sf_dir), rules.sales_rules()))
    path = shared_dir(spark)
    io.save_report(counts, path)
    return spark.read.schema(counts.schema).json(path)


@query
def saved_table(spark, sf_dir):
    """The rule counts as a CSV table with its columns in name order, read back by its header."""
    counts = rounded(rules.violation_counts(faulty(spark, sf_dir), rules.sales_rules()))
    path = shared_dir(spark)
    io.save_result_table(counts, path)
    return conform(io.load_text(spark, path), counts.schema)


@query
def missing_column(spark, sf_dir):
    """A table without a declared column: one violation for the column, none of its own rules."""
    return rounded(rules.violation_counts(faulty(spark, sf_dir).drop("temperature"), rules.sales_rules()))


@query
def validate_requests(spark, sf_dir):
    judged = rules.with_violations(keyed_requests(spark, sf_dir), rules.request_rules())
    return judged.groupBy("store_id").agg(
        F.count_if(F.size("violations") == 0).alias("accepted"), F.count_if(F.size("violations") > 0).alias("rejected")
    )


@query
def load_profile(spark, sf_dir):
    return io.lineage(sales(spark, sf_dir), "sales", SCALE)


@query
def verify_load(spark, sf_dir):
    expected = fp.fingerprint(sales(spark, sf_dir), float_scale=SCALE).first()["fingerprint"]
    shuffled = sales(spark, sf_dir).select(*reversed(contract.SALES_COLUMNS)).repartition(7)
    same = fp.verify(shuffled, expected, SCALE).withColumn("dataset", F.lit("reordered"))
    other = fp.verify(faulty(spark, sf_dir), expected, SCALE).withColumn("dataset", F.lit("faulty"))
    return same.unionByName(other)


def drop_folder(spark, path):
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


@query
def verify_files(spark, sf_dir):
    """A table by month, whose March is written again with faults and whose December is lost: folders that differ."""
    path, rows = shared_dir(spark), sales(spark, sf_dir)
    rows.repartition("month").write.partitionBy("month").parquet(path)
    before = settle(files.file_manifest(spark, path, contract.SALES_SCHEMA, float_scale=SCALE))
    faulty(spark, sf_dir).where("month = 3").drop("month").write.mode("overwrite").parquet(f"{path}/month=3")
    drop_folder(spark, f"{path}/month=12")
    after = files.file_manifest(spark, path, contract.SALES_SCHEMA, before, float_scale=SCALE)
    whole = files.compare_manifests(before.withColumn("folder", F.lit("")), after.withColumn("folder", F.lit("")))
    return files.compare_manifests(before, after).unionByName(whole)


@query
def file_digests(spark, sf_dir):
    """One text file per brand, with its parts in order."""
    path = shared_dir(spark)
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.format_string("%d:%s", "p_partkey", "p_name").alias("value"))
    parts.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select("p_brand", "value").write.partitionBy("p_brand").text(path)
    brand = F.regexp_extract("path", "p_brand=([^/]*)/", 1)
    return files.file_digests(spark, path, "*.txt", 1000).select(F.url_decode(brand).alias("brand"), "n_bytes", "fingerprint")


def event_log(spark, sf_dir):
    """The events as a log by day, with a broken line beside every hundredth; its path and the events' schema."""
    events, path = table(spark, sf_dir, "events"), shared_dir(spark)
    prediction_log.append_log(events, path, "ts")
    broken = F.format_string('{"event_id": %d, broken', "event_id").alias("value")
    some = events.where(F.col("event_id") % 100 == 0)
    some.select(F.date_format("ts", "yyyy-MM-dd").alias(prediction_log.DAY), broken).write.mode("append").partitionBy(prediction_log.DAY).text(path)
    return path, events.schema


LOG_RANGE = ("2024-01-05", "2024-01-20 12:00:00")


@query
def log_range(spark, sf_dir):
    path, schema = event_log(spark, sf_dir)
    log, _ = prediction_log.read_log(spark, path, schema, "ts", *LOG_RANGE)
    return log.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def log_quarantine(spark, sf_dir):
    path, schema = event_log(spark, sf_dir)
    return prediction_log.read_log(spark, path, schema, "ts", *LOG_RANGE)[1]


# --- fingerprints, profile, splits, adapters ---


@query
def table_fingerprint(spark, sf_dir):
    return fp.fingerprint(sales(spark, sf_dir), float_scale=SCALE)


@query
def fingerprint_by_month(spark, sf_dir):
    return fp.fingerprint(sales(spark, sf_dir), by=["month"], float_scale=SCALE)


@query
def profile_numeric(spark, sf_dir):
    return rounded(profile.profile(faulty(spark, sf_dir), SCALE), 5)


@query
def manifest(spark, sf_dir):
    return profile.manifest(by_date(sales(spark, sf_dir)), "sales", splits.SPLIT, float_scale=SCALE)


@query
def chrono_split(spark, sf_dir):
    one = by_date(faulty(spark, sf_dir)).groupBy(F.coalesce("split", F.lit("unassigned")).alias("split"))
    return one.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
        F.round(F.sum("sales_demand"), 3).alias("demand"),
    )


@query
def quantile_split(spark, sf_dir):
    cut = splits.positional_split(sales(spark, sf_dir))
    return cut.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
    )


@query
def reference_baseline(spark, sf_dir):
    baseline = splits.reference_rows(by_date(sales(spark, sf_dir)))
    return rounded(
        baseline.groupBy("product_category").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg("price").alias("price"), F.avg("sales_demand").alias("demand")
        )
    )


@query
def calendar_features(spark, sf_dir):
    one = adapters.calendar_features(table(spark, sf_dir, "events"), "ts")
    return one.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "day_of_week", "month")


def transactions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("unit_price", F.try_divide("l_extendedprice", "l_quantity"))
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))


def shown_sales(df):
    """Four decimals. Averages of a few prices are ties but for the noise of their sums, which differs by engine:
    what lies less than 3e-7 below a tie goes up with it."""
    near = df.withColumns({c: F.col(c) + 3e-7 for c, t in df.dtypes if t == "double"})
    return rounded(near.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")), 4)


@query
def adapt_daily(spark, sf_dir):
    return shown_sales(adapters.adapt_transactions(transactions(spark, sf_dir), "l_shipdate", "n_name", "l_quantity", "unit_price"))


def hourly_counts(spark, sf_dir):
    """Events as an hourly table in the shape of the hourly source."""
    hour = F.date_trunc("hour", "ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("at"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.avg("value").alias("temp"))
        .select(
            F.date_format("at", "yyyy-MM-dd").alias("dteday"),
            F.hour("at").alias("hr"),
            F.quarter("at").alias("season"),
            (F.weekday("at") >= 5).cast("int").alias("holiday"),
            "temp",
            "cnt",
        )
    )


@query
def adapt_hourly(spark, sf_dir):
    return shown_sales(adapters.adapt_hourly(hourly_counts(spark, sf_dir), "dteday", "hr", "season", "holiday", "temp", "cnt"))


def store_days(spark, sf_dir):
    return sales(spark, sf_dir).groupBy("store_id", "date").agg(F.sum("sales_demand").alias("demand"))


@query
def lag_by_store(spark, sf_dir):
    lagged = ordered.lag_in_order(store_days(spark, sf_dir), "demand", "date", "previous", ["store_id"], bucket=F.year("date"))
    return rounded(lagged.withColumn("date", F.date_format("date", "yyyy-MM-dd")), 4)


@query
def lag_hourly(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    lagged = ordered.lag_in_order(events, "value", "ts", "previous")
    return rounded(lagged.drop("ts"))


# --- injection ---


@query
def inject_faults(spark, sf_dir):
    return rounded(
        faulty(spark, sf_dir).groupBy("store_id").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("price").isNull()).alias("null_price"),
            F.count_if(F.col("inventory_level").isNull()).alias("null_inventory"),
            F.count_if(F.col("previous_day_sales").isNull()).alias("null_previous"),
            F.count_if(F.col("date").isNull()).alias("null_date"),
            F.count_if(F.col("price") < 0).alias("negative_price"),
            F.count_if(F.col("inventory_level") < 0).alias("negative_inventory"),
            F.count_if(F.col("product_category") == contract.INVALID_CATEGORY).alias("invalid_category"),
            F.sum(F.when(F.col("price") < 0, F.col("price"))).alias("negative_price_sum"),
        ),
        4,
    )


@query
def inject_drift(spark, sf_dir):
    moved = inject.apply_scenario(sales(spark, sf_dir), "severe_drift", float_scale=SCALE)
    return rounded(
        moved.groupBy("product_category", "promotion_flag").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("price").alias("price"),
            F.avg("competitor_price").alias("competitor_price"),
            F.avg("temperature").alias("temperature"),
            F.avg("sales_demand").alias("demand"),
        ),
        6,
    )


def scenario_tables(spark, sf_dir):
    base = settle(sales(spark, sf_dir))
    return {name: inject.apply_scenario(base, name, float_scale=SCALE) for name in contract.SCENARIOS}


@query
def scenario_gate_matrix(spark, sf_dir):
    return rounded(release.scenario_gates(scenario_tables(spark, sf_dir), float_scale=SCALE))


# --- drift ---


def drift_sides(spark, sf_dir, scenario="severe_drift"):
    """Reference: train and validation rows. Current: test rows under a scenario."""
    split = by_date(sales(spark, sf_dir))
    current = split.where(F.col("split") == "test").drop("split")
    return splits.reference_rows(split), inject.apply_scenario(current, scenario, float_scale=SCALE)


def numeric_distances(spark, sf_dir, scenario="mild_drift"):
    return drift.numeric_distances(*drift_sides(spark, sf_dir, scenario), contract.DRIFT_FEATURES["numerical"])


def category_counts(spark, sf_dir, scenario="severe_drift"):
    return drift.category_counts(*drift_sides(spark, sf_dir, scenario), contract.DRIFT_FEATURES["categorical"])


@query
def drift_ks(spark, sf_dir):
    return rounded(drift.ks_test(numeric_distances(spark, sf_dir)))


@query
def drift_wasserstein(spark, sf_dir):
    return rounded(drift.wasserstein_test(numeric_distances(spark, sf_dir)), 5)


@query
def drift_chi2(spark, sf_dir):
    return rounded(drift.chi_square_test(category_counts(spark, sf_dir)))


@query
def drift_js(spark, sf_dir):
    return rounded(drift.jensen_shannon_test(category_counts(spark, sf_dir)))


@query
def drift_ztest(spark, sf_dir):
    return rounded(drift.proportion_test(*drift_sides(spark, sf_dir, "mild_drift"), ["promotion_flag"]))


def shown_summary(df):
    lists = {c: F.array_join(c, ",") for c in ("drifted_columns", "critical_drifted") if c in df.columns}
    return rounded(df.withColumns(lists))


@query
def drift_summary(spark, sf_dir):
    return shown_summary(drift.drift_summary(drift.drift_by_column(*drift_sides(spark, sf_dir))))


@query
def drift_decision(spark, sf_dir):
    by_column = drift.drift_by_column(*drift_sides(spark, sf_dir))
    return shown_summary(drift.drift_decision(drift.drift_summary(by_column)))


@query
def drift_report(spark, sf_dir):
    return rounded(drift.drift_by_column(*drift_sides(spark, sf_dir, "mild_drift")), 5)


def scenario_drift(spark, sf_dir):
    split = settle(by_date(sales(spark, sf_dir)))
    return monitor.scenario_decisions(
        splits.reference_rows(split), split.where(F.col("split") == "test").drop("split"), contract.SCENARIOS, SCALE
    )


@query
def scenario_drift_matrix(spark, sf_dir):
    return shown_summary(scenario_drift(spark, sf_dir))


@query
def retrain_requests(spark, sf_dir):
    return shown_summary(drift.retrain_requests(scenario_drift(spark, sf_dir), ["scenario"]))


# --- features ---


def faulty_parts(spark, sf_dir):
    """The training rows of the faulty table, and those of all three parts with their ``split``, with row keys."""
    split = by_date(keyed_requests(spark, sf_dir)).where(F.col("split").isNotNull())
    return split.where(F.col("split") == "train").drop("split"), split


@query
def fit_categories(spark, sf_dir):
    return features.fit_categories(faulty_parts(spark, sf_dir)[0], contract.CATEGORICAL_FEATURES)


@query
def fit_medians(spark, sf_dir):
    return rounded(features.fit_medians(faulty_parts(spark, sf_dir)[0], contract.NUMERIC_FEATURES), 9)


@query
def impute(spark, sf_dir):
    train, parts = faulty_parts(spark, sf_dir)
    medians = {r["column_name"]: r["median"] for r in features.fit_medians(train, contract.NUMERIC_FEATURES).collect()}
    return rounded(features.impute(parts, medians).select("split", "row_key", "copy_no", *contract.NUMERIC_FEATURES), 9)


@query
def encode(spark, sf_dir):
    train, parts = faulty_parts(spark, sf_dir)
    vocabulary = settle(features.fit_categories(train, contract.CATEGORICAL_FEATURES))
    return features.encode(parts, vocabulary, contract.CATEGORICAL_FEATURES).select(
        "split", "row_key", "copy_no", *contract.CATEGORICAL_FEATURES
    )


@query
def derive_features(spark, sf_dir):
    return rounded(features.derive(keyed_requests(spark, sf_dir)).select("row_key", "copy_no", *contract.DERIVED_FEATURES), 9)


@query
def feature_matrix(spark, sf_dir):
    train, parts = faulty_parts(spark, sf_dir)
    model = features.DemandFeatures().fit(train)
    matrix = model.transform(parts)
    return rounded(
        matrix.groupBy("split").agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in [*model.feature_names, contract.TARGET]]
        ),
        5,
    )


# --- metrics, gates, readiness ---


def with_predictions(df):
    """Two deterministic predictors: ``ungated`` ignores promotions, ``prediction`` knows them."""
    carried = 0.1 * F.col("previous_day_sales")
    return df.withColumns({"ungated": 107.5 + carried, "prediction": 100 + 30 * F.col("promotion_flag") + carried})


@query
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(with_predictions(sales(spark, sf_dir)), "sales_demand", "prediction", digits=None))


@query
def metrics_by_segment(spark, sf_dir):
    scored = with_predictions(sales(spark, sf_dir))
    return rounded(metrics.regression_metrics(scored, "sales_demand", "ungated", ["product_category", "store_id"], None))


@query
def latency_summary(spark, sf_dir):
    return rounded(metrics.latency_summary(table(spark, sf_dir, "events"), "value", 100))


def scenario_metrics(spark, sf_dir, scenarios=None):
    """(scenario, mae, rmse, r2, mape, ...) of the fixed predictor under each scenario, gaps filled with the
    median of the clean training rows. ``scenarios``: the tables of :func:`scenario_tables`, if they are there."""
    train = by_date(sales(spark, sf_dir)).where(F.col("split") == "train")
    medians = {r["column_name"]: r["median"] for r in features.fit_medians(train, ["previous_day_sales"]).collect()}
    parts = [
        metrics.regression_metrics(with_predictions(features.impute(df, medians)), "sales_demand", "prediction", digits=None)
        .withColumn("scenario", F.lit(name))
        for name, df in (scenarios or scenario_tables(spark, sf_dir)).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def recorded_latency(spark, sf_dir):
    """One row: latency_ms, the recorded durations per record."""
    summary = metrics.latency_summary(table(spark, sf_dir, "events"), "value", 100)
    return summary.select(F.col("per_record").alias("latency_ms"))


def measured_scenarios(spark, sf_dir, scenarios=None):
    """One row of latency beside one row of metrics per scenario."""
    return scenario_metrics(spark, sf_dir, scenarios).crossJoin(recorded_latency(spark, sf_dir))


def scenario_model_gate(spark, sf_dir, measured=None):
    measured = measured_scenarios(spark, sf_dir) if measured is None else measured
    rows = metrics.to_metric_rows(measured, ["scenario"], [*metrics.METRICS, "latency_ms"])
    return gates.model_gate(rows, gates.threshold_table(spark), ["scenario"])


@query
def model_gate(spark, sf_dir):
    return rounded(scenario_model_gate(spark, sf_dir))


def scenario_readiness(spark, sf_dir, scenarios=None, measured=None):
    """The gates of every scenario; the same tables serve the data gate and the metrics, given or read here."""
    scenarios = scenarios or scenario_tables(spark, sf_dir)
    measured = measured_scenarios(spark, sf_dir, scenarios) if measured is None else measured
    reports = settle(release.scenario_gates(scenarios, float_scale=SCALE))
    data = reports.select("scenario", (F.col("overall_status") == "PASS").alias("passed"), F.lit("").alias("failed_rules"))
    model = gates.gate_verdict(scenario_model_gate(spark, sf_dir, measured), ["scenario"])
    return gates.deployment_readiness(reports.select("scenario"), data, model, ["scenario"])


@query
def deployment_readiness(spark, sf_dir):
    return scenario_readiness(spark, sf_dir)


# --- ledger, statistics, comparison ---


@query
def experiment_matrix(spark, sf_dir):
    data = fp.fingerprint(sales(spark, sf_dir), float_scale=SCALE)
    return ledger.experiment_matrix(spark).crossJoin(data.select("n_rows", "fingerprint"))


def run_ledger(spark, sf_dir):
    """Metrics of both predictors under seed-dependent noise, for every variant and seed."""
    scored = with_predictions(sales(spark, sf_dir))
    seeds = F.explode(F.array(*[F.lit(s) for s in contract.RUN_SEEDS]))
    noise = ((F.col("inventory_level") * F.col("seed")) % 101 - 50) / 25
    cells = F.array(
        F.struct(F.lit("baseline").alias("pipeline"), (F.col("ungated") + noise).alias("p")),
        F.struct(F.lit("proposed").alias("pipeline"), (F.col("prediction") + noise).alias("p")),
    )
    runs = scored.select("*", seeds.alias("seed")).select("seed", "sales_demand", F.inline(cells))
    wide = metrics.regression_metrics(runs, "sales_demand", "p", ["pipeline", "seed"], None)
    plan = ledger.experiment_matrix(spark).select("variant", "pipeline", "seed")
    rows = metrics.to_metric_rows(wide, ["pipeline", "seed"])
    return plan.join(rows, ["pipeline", "seed"]).withColumn("status", F.lit("COMPLETED"))


@query
def run_aggregate(spark, sf_dir):
    stats = metrics.run_statistics(run_ledger(spark, sf_dir), ["variant", "metric"])
    shown = F.array_join(F.transform("values", lambda v: F.round(v, 6).cast("decimal(18,6)").cast("string")), ",")
    return rounded(stats.withColumn("values", shown), 6)


@query
def run_wide(spark, sf_dir):
    return rounded(ledger.run_wide(run_ledger(spark, sf_dir), ["variant", "pipeline", "seed", "status"]))


@query
def champion(spark, sf_dir):
    month = F.date_trunc("month", "date")
    scored = with_predictions(sales(spark, sf_dir)).withColumn("registered_at", month)
    wide = metrics.regression_metrics(scored, "sales_demand", "prediction", ["product_category", "registered_at"], None)
    runs = wide.withColumns(
        {
            "gates_passed": (F.col("rmse") <= 14.4) & (F.col("r2") >= 0.5),
            "version": F.year("registered_at") * 100 + F.month("registered_at"),
        }
    )
    return ledger.champion(runs, ["product_category"]).withColumn("registered_at", F.date_format("registered_at", "yyyy-MM-dd"))


def two_runs(spark, sf_dir):
    """The predictor on the stored table, and again on a reordered copy with a tiny disturbance."""
    base = inject.with_row_key(with_predictions(sales(spark, sf_dir)).select(*contract.SALES_COLUMNS, "prediction"), SCALE)
    again = base.withColumn("prediction", F.col("prediction") + F.col("temperature") * 1e-7)
    return base, again


def segment_metrics(df, predicted="prediction"):
    wide = metrics.regression_metrics(df, "sales_demand", predicted, ["product_category"], None)
    return metrics.to_metric_rows(wide, ["product_category"])


@query
def metric_diff(spark, sf_dir):
    scored = with_predictions(sales(spark, sf_dir))
    moved = scored.withColumn("other", F.col("prediction") + F.col("temperature") * 1e-2)
    return rounded(repro.metric_diff(segment_metrics(scored), segment_metrics(moved, "other"), ["product_category"]))


@query
def prediction_diff(spark, sf_dir):
    one, again = two_runs(spark, sf_dir)
    far = one.withColumn("prediction", F.col("prediction") + F.col("temperature") * 1e-3)
    near = repro.prediction_diff(one, again, [inject.KEY]).withColumn("pair", F.lit("near"))
    return rounded(near.unionByName(repro.prediction_diff(one, far, [inject.KEY]).withColumn("pair", F.lit("far"))), 9)


def store_categories(spark, sf_dir):
    """Per store: categories sold in the training rows and in the last month of the test rows."""
    split = by_date(sales(spark, sf_dir))
    recent = (F.col("split") == "test") & (F.col("date") >= F.to_timestamp(F.lit("2001-11-01")))
    return split.groupBy("store_id").agg(
        F.collect_set(F.when(F.col("split") == "train", F.col("product_category"))).alias("f1"),
        F.collect_set(F.when(recent, F.col("product_category"))).alias("f2"),
    )


@query
def feature_diff(spark, sf_dir):
    return repro.feature_diff(store_categories(spark, sf_dir), "f1", "f2", ["store_id"])


@query
def repro_report(spark, sf_dir):
    one, again = two_runs(spark, sf_dir)
    expected = fp.fingerprint(one.select(*contract.SALES_COLUMNS), float_scale=SCALE).first()["fingerprint"]
    return repro.repro_report(
        {
            "dataset_fingerprint": fp.verify(again.select(*contract.SALES_COLUMNS), expected, SCALE),
            "features": repro.feature_diff(store_categories(spark, sf_dir), "f1", "f2", ["store_id"]),
            "metrics": repro.metric_diff(segment_metrics(one), segment_metrics(again), ["product_category"]),
            "predictions": repro.prediction_diff(one, again, [inject.KEY]),
        }
    )


def scenario_runs(spark, sf_dir):
    """One row per scenario and pipeline, from gates, metrics and drift decisions."""
    scenarios = scenario_tables(spark, sf_dir)
    # Five rows, which the model gate and the comparison both read.
    measured = settle(measured_scenarios(spark, sf_dir, scenarios))
    ready = scenario_readiness(spark, sf_dir, scenarios, measured)
    drifted = scenario_drift(spark, sf_dir).select("scenario", "dataset_drift", "decision")
    one = ready.join(drifted, "scenario").join(measured.select("scenario", *metrics.METRICS, "latency_ms"), "scenario")
    verdict = lambda c: F.when(F.col(c), "PASS").otherwise("FAIL")
    return one.select(
        F.explode(F.array(F.lit("baseline"), F.lit("proposed"))).alias("pipeline"),
        "scenario",
        verdict("data_validation_passed").alias("data_status"),
        verdict("model_quality_passed").alias("model_status"),
        F.col("deployable").alias("registered"),
        F.col("dataset_drift").alias("drift_detected"),
        "decision",
        *metrics.METRICS,
        *[F.lit(None).cast("double").alias(c) for c in ("train_seconds", "total_seconds")],
        "latency_ms",
        F.lit(True).alias("reproducible"),
    )


@query
def release_comparison(spark, sf_dir):
    return rounded(ledger.release_comparison(scenario_runs(spark, sf_dir)), 5)


@query
def release_confusion(spark, sf_dir):
    ready = scenario_readiness(spark, sf_dir)
    labelled = ready.select(
        F.explode(F.array(F.lit("baseline"), F.lit("proposed"))).alias("pipeline"),
        F.col("scenario").isin("clean", "mild_drift").alias("valid"),
        "deployable",
    ).withColumn("released", (F.col("pipeline") == "baseline") | F.col("deployable"))
    return rounded(ledger.release_confusion(labelled, ["pipeline"]))


@query
def drift_confusion(spark, sf_dir):
    decided = scenario_drift(spark, sf_dir)
    alerts = decided.select(
        F.col("scenario").isin("mild_drift", "severe_drift", "performance_degradation").alias("drifted"),
        (F.col("decision") != "CONTINUE").alias("alerted"),
    )
    return rounded(ledger.drift_confusion(alerts))


@query
def overhead(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pairs = events.groupBy("user_id", F.weekday("ts").alias("day")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("plain"),
        F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("gated"),
    )
    return rounded(ledger.overhead(pairs, ["day"], "plain", "gated"))


@query
def overhead_by_user(spark, sf_dir):
    """A group per user: as many groups as the table has users."""
    events = table(spark, sf_dir, "events")
    pairs = events.groupBy("user_id", F.weekday("ts").alias("day")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("plain"),
        F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("gated"),
    )
    return rounded(ledger.overhead(pairs, ["user_id"], "plain", "gated"))


@query
def row_difference(spark, sf_dir):
    """Line items before and after the largest ones are returned, without their keys, so that rows repeat."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    flag = F.when(F.col("l_quantity") >= 50, "R").otherwise(F.col("l_returnflag"))
    return repro.row_difference(lines, lines.withColumn("l_returnflag", flag))


@query
def check_scores(spark, sf_dir):
    return rounded(ledger.check_scores(scenario_model_gate(spark, sf_dir), ["scenario"]))


def store_errors(spark, sf_dir, period):
    """Mean absolute errors of both predictors per store and period."""
    scored = with_predictions(sales(spark, sf_dir))
    return scored.groupBy("store_id", F.date_format(F.date_trunc(period, "date"), "yyyyMMdd").alias("at")).agg(
        F.avg(F.abs(F.col("sales_demand") - F.col("ungated"))).alias("plain"),
        F.avg(F.abs(F.col("sales_demand") - F.col("prediction"))).alias("gated"),
    ).select(F.concat_ws("~", "store_id", "at").alias("pair"), "plain", "gated", (F.col("plain") - F.col("gated")).alias("gain"))


@query
def paired_permutation(spark, sf_dir):
    return rounded(resample.paired_permutation(store_errors(spark, sf_dir, "month"), "pair", "gain"))


@query
def bootstrap_ci(spark, sf_dir):
    return rounded(resample.bootstrap_ci(store_errors(spark, sf_dir, "week"), "pair", "gain"))


def daily_alerts(spark, sf_dir):
    """Daily means per event type; a day alerts if it leaves the range of the days before the onset."""
    days = window_stats(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value")
    before = days.where(F.col("window_start") < F.to_timestamp(F.lit(ONSET))).groupBy("event_type").agg(
        F.min("mean").alias("low"), F.max("mean").alias("high")
    )
    return days.join(before, "event_type").withColumn("alert", (F.col("mean") < F.col("low")) | (F.col("mean") > F.col("high")))


@query
def detection_delay(spark, sf_dir):
    out = ledger.detection_delay(daily_alerts(spark, sf_dir), ["event_type"], "window_start", "alert", F.to_timestamp(F.lit(ONSET)))
    return out.withColumn("first_alert", F.date_format("first_alert", "yyyy-MM-dd"))


# --- training, scoring ---


def trained(spark, sf_dir):
    split = by_date(sales(spark, sf_dir))
    model = boosting.train(split.where(F.col("split") == "train").drop("split"))
    return model, split.where(F.col("split") == "test").drop("split")


def better_than_mean(scored):
    """(n, beats_mean): whether the model's squared error on the test rows is below half of that of their mean."""
    wide = metrics.regression_metrics(scored, "sales_demand", boosting.PREDICTION, digits=None)
    return wide.select("n", (F.col("r2") > 0.5).alias("beats_mean"))


@query
def train_score(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    return better_than_mean(boosting.score(model, test))


def checked_predictions(df, published):
    """The prediction as what SQL can decide of it: present, not negative, and as published."""
    p = F.col("prediction")
    right = p.isNotNull() & ~F.isnan(p) & (p >= 0)
    return df.withColumn("valid", right & (F.round(p, 2) == p) if published else right).drop("prediction")


@query
def score_batch(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    keyed = inject.with_row_key(test, SCALE).withColumnRenamed(inject.KEY, "row_key")
    scored = boosting.published(boosting.score(model, keyed))
    return checked_predictions(scored.select("row_key", "store_id", "product_category", "prediction"), True)


def logged(rows, *more):
    shown = rows.select("request_id", "model_version", "store_id", "product_category", "promotion_flag", "month", "prediction", *more)
    return checked_predictions(shown, False)


@query
def score_log(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    keyed = inject.with_row_key(test, SCALE)
    rows = requests.log_rows(boosting.score(model, keyed), "v1", F.col(inject.KEY), F.col("date"))
    path = shared_dir(spark)
    prediction_log.append_predictions(rows, path)
    found = prediction_log.load_predictions(spark, path)
    return logged(found, F.date_format("timestamp", "yyyy-MM-dd").alias("timestamp"))


@query
def run_experiments(spark, sf_dir):
    ledger = experiment.run_matrix(by_date(sales(spark, sf_dir)), "clean")
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    return ledger.select("variant", "pipeline", "seed", "status", "metric", "error", finite.alias("measured"))


# --- streams ---


@query
def stream_quarantine(spark, sf_dir):
    lines = tables.stream(spark, sf_dir, "lineitem")
    keyed = inject.with_row_key(sales(spark, sf_dir, lines), SCALE)
    n_rows = sales(spark, sf_dir).count()  # a stream cannot count itself
    faults = contract.SCENARIOS["data_quality_failure"]["faults"]
    bad = inject.inject_faults(keyed, faults, n_rows=n_rows).withColumnsRenamed({inject.KEY: "row_key", inject.COPY: "copy_no"})
    path = shared_dir(spark)
    requests.quarantine_stream(bad, rules.request_rules(), path, shared_dir(spark)).awaitTermination()
    judged = spark.read.parquet(path)
    return judged.select("row_key", "copy_no", F.array_join("violations", ",").alias("violations"), "verdict")


@query
def stream_score(spark, sf_dir):
    model, _ = trained(spark, sf_dir)
    incoming = inject.with_row_key(sales(spark, sf_dir, tables.stream(spark, sf_dir, "lineitem")), SCALE)
    path = shared_dir(spark)
    requests.score_stream(incoming, model, "v1", F.col(inject.KEY), path).awaitTermination()
    return logged(spark.read.parquet(path))


@query
def window_monitor(spark, sf_dir):
    events = tables.stream(spark, sf_dir, "events")
    stats = window_stats(events, "ts", "1 day", ["event_type"], "value", watermark="1 hour")
    path = shared_dir(spark)
    update_files(stats, path, shared_dir(spark)).awaitTermination()
    found = latest_windows(spark, path, stats.schema, ["window_start", "event_type"])
    return rounded(found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


@query
def window_drift(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    early = events.where(F.col("ts") < F.to_timestamp(F.lit(ONSET))).groupBy(F.col("event_type").alias("category"))
    reference = early.agg(F.count(F.lit(1)).alias("n"))
    counts = category_windows(tables.stream(spark, sf_dir, "events"), "ts", "1 day", "event_type", watermark="1 hour")
    path = shared_dir(spark)
    update_files(counts, path, shared_dir(spark)).awaitTermination()
    found = category_drift(latest_windows(spark, path, counts.schema, ["window_start", "category"]), reference)
    return rounded(found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


def event_numbers(events):
    """Numbers of each event: its value, the number in its properties, its hour and its user."""
    return events.select(
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"),
        F.col("user_id").cast("double").alias("user"),
    )


@query
def window_numeric_drift(spark, sf_dir):
    before = table(spark, sf_dir, "events").where(F.col("ts") < F.to_timestamp(F.lit(ONSET)))
    bins = fit_bins(event_numbers(before), ["value", "k", "hour", "user"])
    states = binned_windows(event_numbers(tables.stream(spark, sf_dir, "events")), "ts", "1 day", bins, watermark="1 hour")
    path = shared_dir(spark)
    update_files(states, path, shared_dir(spark)).awaitTermination()
    found = numeric_window_drift(latest_windows(spark, path, states.schema, ["window_start", "feature", "bin"]), bins)
    return rounded(found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


def shifted_numbers(events):
    """The numbers of events, of which values and users move on the 20th and properties on the 25th."""
    day, numbers = F.dayofmonth("ts"), event_numbers(events)
    return numbers.withColumns(
        {
            "value": F.when(day >= 20, F.col("value") * 2 + 50).otherwise(F.col("value")),
            "user": F.when(day >= 20, F.col("user") + 100000).otherwise(F.col("user")),
            "k": F.when(day >= 25, F.col("k") + 1000).otherwise(F.col("k")),
        }
    )


@query
def retrain_trigger(spark, sf_dir):
    before = table(spark, sf_dir, "events").where(F.col("ts") < F.to_timestamp(F.lit(ONSET)))
    bins = fit_bins(event_numbers(before), ["value", "k", "hour", "user"])
    states = binned_windows(shifted_numbers(tables.stream(spark, sf_dir, "events")), "ts", "1 day", bins, watermark="1 hour")
    path = shared_dir(spark)
    retrain_stream(states, bins, "events", path, shared_dir(spark), critical=[]).awaitTermination()
    found = read_requests(spark, path).drop("batch_no").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
    return rounded(found.withColumn("drifted_columns", F.array_join("drifted_columns", ",")))


@query
def window_fingerprint(spark, sf_dir):
    hashes = window_fingerprints(tables.stream(spark, sf_dir, "events"), "ts", "1 day", "1 hour", SCALE)
    path = shared_dir(spark)
    update_files(hashes, path, shared_dir(spark)).awaitTermination()
    found = latest_windows(spark, path, hashes.schema, ["window_start"])
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
