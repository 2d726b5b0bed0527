"""Time the headline queries after an unmeasured warm-up; prints one JSON line with first and second runs.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) set input and cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "validate_rules",
    "duplicate_ratio",
    "table_fingerprint",
    "drift_ks",
    "drift_wasserstein",
    "quantile_split",
    "fit_medians",
    "bootstrap_ci",
    "validation_report",
    "train_score",
]


def local_session(cpus: str | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluicegate")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


WARM_UP, SLOW = "quality_gate", ("train_score",)


def run(spark: SparkSession, query, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    from workload.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    run(spark, QUERIES[WARM_UP], sf_dir)
    first = {name: run(spark, QUERIES[name], sf_dir) for name in HEADLINE}
    again = {name: run(spark, QUERIES[name], sf_dir) for name in HEADLINE if name not in SLOW}
    spark.stop()
    total = round(sum(first.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": first, "second_run": again, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
