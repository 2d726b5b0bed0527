from __future__ import annotations

import math
import shutil
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators import boosting, features, inject, ledger, metrics, repro, resample, splits
from sluicegate.plans import experiment, release
from sluicegate.session import shared_dir


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_regression_metrics_by_hand(spark):
    df = frame(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    assert (m["mae"], m["rmse"], m["r2"]) == (1.0, 1.291, 0.375)
    assert m["mape"] == pytest.approx((1 + 0 + 0.4) / 3, abs=1e-4)


def test_regression_metrics_edges(spark):
    empty = metrics.regression_metrics(frame(spark, [], "y double, p double"), "y", "p").first()
    assert [empty[c] for c in ("n", "mae", "rmse", "r2", "mape")] == [0, 0.0, 0.0, 0.0, 0.0]
    exact = metrics.regression_metrics(frame(spark, [(2.0, 2.0)] * 2, "y double, p double"), "y", "p").first()
    assert exact["r2"] == 1.0
    off = metrics.regression_metrics(frame(spark, [(2.0, 3.0)] * 2, "y double, p double"), "y", "p").first()
    assert off["r2"] == 0.0


def test_run_statistics(spark):
    rows = [("v", "rmse", 1, "COMPLETED", 2.0), ("v", "rmse", 2, "COMPLETED", 4.0), ("v", "rmse", 3, "FAILED", None), ("w", "rmse", 1, "COMPLETED", 5.0)]
    df = frame(spark, rows, "variant string, metric string, seed int, status string, value double")
    out = {r["variant"]: r for r in metrics.run_statistics(df, ["variant", "metric"]).collect()}
    v = out["v"]
    assert (v["n"], v["n_failed"], v["mean"], v["values"]) == (2, 1, 3.0, [2.0, 4.0])
    assert v["std"] == pytest.approx(math.sqrt(2))
    assert v["ci95_low"] < 3 < v["ci95_high"]
    assert (out["w"]["std"], out["w"]["ci95_low"]) == (0.0, 5.0)


def test_categories_medians_and_encoding(spark, sales):
    codes = features.fit_categories(sales, ["product_category", "day_of_week"]).collect()
    assert {(r["category"], r["code"]) for r in codes if r["column_name"] == "product_category"} == {
        (c, i) for i, c in enumerate(sorted(contract.CATEGORIES), 1)
    }
    model = features.DemandFeatures().fit(sales)
    odd = sales.limit(3).withColumns({"product_category": F.lit("Unknown"), "price": F.lit(None).cast("double")})
    row = model.transform(odd.drop("store_id", "temperature")).first()
    assert (row["product_category"], row["store_id"]) == (0, 0)
    wanted = {r["column_name"]: r["median"] for r in features.fit_medians(sales, ["price", "temperature"]).collect()}
    assert (row["price"], row["temperature"]) == (wanted["price"], wanted["temperature"])
    assert row["price_diff"] == pytest.approx(row["price"] - row["competitor_price"])


def test_saved_model_holds_its_vocabulary(spark, sales, tmp_path):
    rows = spark.range(25_000).selectExpr("concat('c', id) AS store_id", "cast(id AS double) AS price", "1.0D AS sales_demand")
    model = features.DemandFeatures(categorical=["store_id"], numeric=["price"]).fit(rows)
    model.write().save(f"{tmp_path}/here")
    shutil.move(f"{tmp_path}/here", f"{tmp_path}/there")
    again = features.DemandFeaturesModel.load(f"{tmp_path}/there")
    assert again.getOrDefault(again.vocabularyPath).startswith(f"{tmp_path}/there")
    coded = again.transform(rows)
    assert coded.agg(F.countDistinct("store_id"), F.min("store_id"), F.max("store_id")).first() == (25_000, 1, 25_000)
    assert coded.exceptAll(model.transform(rows)).count() == 0


def test_median_of_an_all_null_column_is_zero(spark):
    df = frame(spark, [(None, 1.0)], "a double, b double")
    assert {r["column_name"]: r["median"] for r in features.fit_medians(df, ["a", "b"]).collect()} == {"a": 0.0, "b": 1.0}


def test_unfitted_model_raises(sales):
    with pytest.raises(RuntimeError):
        features.DemandFeaturesModel().transform(sales)


@pytest.fixture(scope="module")
def split_sales(sales):
    return splits.chronological_split(sales, "1999-06-30", "2000-06-30", "2001-12-31")


@pytest.fixture(scope="module")
def model(split_sales):
    return boosting.train(split_sales.where("split = 'train'").drop("split"), maxIter=3)


def test_model_scores_saves_and_reloads(spark, sales, split_sales, model):
    scored = boosting.score(model, sales)
    assert scored.columns == [*sales.columns, "prediction"]
    assert scored.agg(F.min("prediction")).first()[0] >= 0
    path = shared_dir(spark)
    model.write().save(path)
    again = boosting.score(PipelineModel.load(path), sales)
    assert again.exceptAll(scored).count() == 0
    assert boosting.iteration_errors(model, split_sales.where("split = 'validation'")).count() == 3
    meta = boosting.training_metadata(model, split_sales.where("split = 'train'")).first()
    assert (meta["n_trees"], meta["n_features"]) == (3, 12)


def test_category_codes_are_nominal_features(split_sales):
    train = split_sales.where("split = 'train'").drop("split")
    _, matrix = boosting.prepare(train)
    attributes = matrix.schema[boosting.FEATURES].metadata["ml_attr"]
    assert {a["name"]: a["num_vals"] for a in attributes["attrs"]["nominal"]} == {
        c: train.select(c).distinct().count() + 1 for c in contract.CATEGORICAL_FEATURES
    }
    assert attributes["num_attrs"] == 12
    model = boosting.booster(maxIter=1).fit(matrix)
    assert " in {" in model.toDebugString
    matrix.unpersist()


def test_training_is_repeatable(split_sales, model):
    train = split_sales.where("split = 'train'").drop("split")
    again = boosting.train(train, maxIter=3)
    assert again.stages[-1].toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]


def test_release_aborts_on_bad_data_and_registers_good(spark, sales, split_sales):
    bad = inject.apply_scenario(sales, "data_quality_failure")
    aborted = release.run_release(splits.chronological_split(bad, "1999-06-30", "2000-06-30", "2001-12-31"), "bad", maxIter=1)
    assert (aborted["status"], aborted["registered"]) == ("ABORTED", False)
    path = shared_dir(spark)
    fine = release.run_release(split_sales, "clean", model_path=path, maxIter=30, stepSize=0.2)
    assert (fine["status"], fine["data_status"], fine["model_status"], fine["registered"]) == ("COMPLETED", "PASS", "PASS", True)
    assert PipelineModel.load(path).stages


def test_failed_runs_become_ledger_rows(split_sales):
    runs = experiment.run_matrix(split_sales, "clean", [("proposed", "proposed", "")], [1], maxIter=-5)
    row = runs.first()
    assert (runs.count(), row["status"], row["metric"]) == (1, "FAILED", None)


def test_matrix_needs_variants_and_seeds(spark):
    assert ledger.experiment_matrix(spark).count() == 50
    with pytest.raises(ValueError):
        ledger.experiment_matrix(spark, variants=[])
    with pytest.raises(ValueError):
        ledger.experiment_matrix(spark, seeds=[])


def metric_rows(spark, **values):
    return frame(spark, list(values.items()), "metric string, value double")


def test_metric_tolerances(spark):
    near = repro.metric_diff(metric_rows(spark, rmse=10.005, r2=0.8502), metric_rows(spark, rmse=10.006, r2=0.8501, extra=1.0))
    assert near.count() == 2 and near.where("matches").count() == 2
    far = repro.metric_diff(metric_rows(spark, rmse=10.0, gone=1.0), metric_rows(spark, rmse=15.0))
    assert far.where("matches").count() == 0 and far.count() == 2


def test_prediction_diff(spark):
    a = frame(spark, [(1, 10.5), (2, 20.2), (3, 30.1)], "k int, prediction double")
    same = repro.prediction_diff(a, a, ["k"]).first()
    assert (same["max_diff"], same["matches"]) == (0.0, True)
    short = repro.prediction_diff(a, a.where("k < 3"), ["k"]).first()
    assert (short["shape_matches"], short["matches"]) == (False, False)


def test_row_difference(spark):
    a = frame(spark, [(1,), (1,), (2,)], "k int")
    b = frame(spark, [(1,), (3,)], "k int")
    assert {(r["k"], r["side"]) for r in repro.row_difference(a, b).collect()} == {(1, "left"), (2, "left"), (3, "right")}


def test_row_difference_of_copies_nulls_types_and_names(spark):
    schema = "`it's` int, `a.b` double, t string"
    left = spark.createDataFrame([(1, 0.5, "x")] * 25_003 + [(2, None, None), (3, float("nan"), ""), (4, 0.0, "z")], schema)
    right = spark.createDataFrame([("x", 1, 0.5)] * 2 + [(None, 2, None), ("", 3, float("nan")), ("z", 4, -0.0), ("y", 5, 1.0)], "t string, `it's` bigint, `a.b` double")
    found = Counter(tuple(r) for r in repro.row_difference(left, right).collect())
    assert found == {(1, 0.5, "x", "left"): 25_001, (5, 1.0, "y", "right"): 1}
    assert repro.row_difference(left, left).count() == 0 and repro.row_difference(left, left.limit(0)).count() == left.count()
    with pytest.raises(ValueError):
        repro.row_difference(left.withColumnRenamed("t", "side"), left)


def test_row_difference_moves_only_buckets_that_differ(spark, capsys):
    left = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") == 77, 9).otherwise(F.col("v")))
    one, two = (repro._bucketed(df, {"id": "bigint", "v": "bigint"}, "b", 512) for df in (left, right))
    assert 1 <= repro.differing_buckets(one, two, "b", ["id", "v"]).count() <= 2
    assert repro.differing_buckets(one, one, "b", ["id", "v"]).count() == 0
    found = repro.row_difference(left, right)
    assert {tuple(r) for r in found.collect()} == {(77, 0, "left"), (77, 9, "right")}
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("LeftSemi") >= 2 and plan.index("hashpartitioning(id") < plan.index("LeftSemi")


def test_overhead_of_many_groups_collects_nothing(spark):
    pairs = spark.range(30_000).select((F.col("id") % 5000).alias("g"), F.lit(2.0).alias("a"), (F.lit(2.0) + F.col("id") / 5000).alias("b"))
    found = {r["g"]: r for r in ledger.overhead(pairs, ["g"], "a", "b").collect()}
    assert len(found) == 5000 and all(r["n"] == 6 for r in found.values())
    assert all(abs(found[g]["median_ratio"] - (g / 5000 + 2.5) / 2) < 1e-9 for g in (0, 1, 4999))


def test_confusion_and_delay(spark):
    d = frame(spark, [(True, True), (True, False), (False, False), (False, True)], "valid boolean, released boolean")
    row = ledger.release_confusion(d).first()
    assert (row["blocked_invalid_rate"], row["false_block_rate"], row["decision_accuracy"]) == (0.5, 0.5, 0.5)
    one_sided = ledger.drift_confusion(frame(spark, [(True, False)], "drifted boolean, alerted boolean")).first()
    assert (one_sided["precision"], one_sided["recall"], one_sided["f1"]) == (None, 0.0, None)


def test_comparison_of_an_aborted_run(spark):
    schema = (
        "pipeline string, scenario string, data_status string, model_status string, registered boolean, drift_detected boolean, decision string, "
        "mae double, rmse double, r2 double, mape double, train_seconds double, total_seconds double, latency_ms double, reproducible boolean"
    )
    rows = [("proposed", "bad", "FAIL", None, False, None, None) + (None,) * 8, ("baseline", "bad", None, None, False, None, None) + (1.0,) * 7 + (None,)]
    out = {r["pipeline_type"]: r for r in ledger.release_comparison(frame(spark, rows, schema)).collect()}
    gated = out["gated"]
    assert (gated["model_quality_gate_status"], gated["deployable"], gated["invalid_release_prevented"], gated["rmse"]) == ("NOT_RUN", "No (Blocked)", "Yes", 0.0)
    assert out["baseline"]["deployable"] == "Yes (Unverified)"
    assert len(out["gated"]) == 19


def test_champion_is_the_latest_passing_version(spark):
    rows = [("m", 1, "2024-01-01", True), ("m", 2, "2024-02-01", True), ("m", 3, "2024-03-01", False)]
    df = frame(spark, rows, "model string, version int, registered_at string, gates_passed boolean")
    assert ledger.champion(df, ["model"]).first()["version"] == 2


def test_permutation_and_bootstrap(spark):
    df = spark.range(60).select("id", (F.lit(1.0) + (F.col("id") % 5) / 10).alias("gain"))
    p = resample.paired_permutation(df, "id", "gain", 99).first()
    assert (p["n"], p["p_value"]) == (60, 0.01)
    ci = resample.bootstrap_ci(df, "id", "gain", 99).first()
    assert ci["ci_low"] < ci["mean"] < ci["ci_high"]
    assert ci["mean"] == pytest.approx(1.2)


def test_stored_folders_are_deleted_on_demand(spark, sales):
    from pathlib import Path

    from sluicegate.session import drop_stored, settle

    path = Path(settle(sales.limit(5)).inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and drop_stored(spark) >= 1 and not path.exists()


def test_matrix_fails_as_rows_when_preparation_raises(split_sales):
    broken = split_sales.drop("sales_demand")
    runs = experiment.run_matrix(broken, "clean", [("proposed", "proposed", ""), ("baseline", "baseline", "")], [1, 2]).collect()
    assert len(runs) == 4 and {r["status"] for r in runs} == {"FAILED"} and all(r["error"] for r in runs)


def test_missing_predictions_count_in_no_term(spark):
    rows = frame(spark, [(1.0, 1.5), (2.0, 2.5), (30.0, None), (None, 4.0)], "y double, p double")
    some = metrics.regression_metrics(rows, "y", "p").first()
    whole = metrics.regression_metrics(rows.where("y IS NOT NULL AND p IS NOT NULL"), "y", "p").first()
    assert some == whole and some["n"] == 2


def test_repeated_keys_are_paired(spark):
    run = frame(spark, [(1, 0.5), (1, 0.7), (2, 0.1)], "k int, prediction double")
    same = repro.prediction_diff(run, run, ["k"]).first()
    assert (same["n_matched"], same["matches"]) == (3, True)


def test_resampling_of_empty_tables_missing_values_and_repeated_rows(spark):
    empty = frame(spark, [], "id bigint, gain double")
    assert resample.paired_permutation(empty, "id", "gain", 9).collect() == []
    assert resample.bootstrap_ci(empty, "id", "gain", 9).collect() == [(0, None, None, None)]
    some = frame(spark, [(1, 2.0), (2, None), (3, 4.0), (3, 4.0), (None, 2.0)], "id bigint, gain double")
    permuted, interval = resample.paired_permutation(some, "id", "gain", 9), resample.bootstrap_ci(some, "id", "gain", 9)
    assert (permuted.first()["n"], interval.first()["n"], interval.first()["mean"]) == (4, 4, 3.0)
    assert interval.first()["ci_low"] <= 3.0 <= interval.first()["ci_high"]
