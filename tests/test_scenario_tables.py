from __future__ import annotations

import datetime

import pytest

from sluicegate import contract
from workload import queries


@pytest.mark.parametrize(("name", "rows"), [("scenario_readiness", 5), ("scenario_runs", 10)])
def test_scenarios_are_built_and_measured_once(spark, monkeypatch, name, rows):
    day = datetime.datetime(1999, 1, 4)
    own = [(day + datetime.timedelta(days=90 * i), f"store_{i % 3:03d}", "Food", i % 2, 10.0 + i, 5.0, 9.0, 20.0, 0, 1, 3.0, 7.0 + i) for i in range(12)]
    calls = []

    def counted(f):
        real = getattr(queries, f)
        monkeypatch.setattr(queries, f, lambda *args: calls.append(f) or real(*args))

    monkeypatch.setattr(queries, "sales", lambda spark, sf_dir: spark.createDataFrame(own, contract.SALES_SCHEMA))
    monkeypatch.setattr(queries, "recorded_latency", lambda spark, sf_dir: spark.createDataFrame([(1.0,)], "latency_ms double"))
    counted("scenario_tables")
    counted("scenario_metrics")
    found = getattr(queries, name)(spark, "")
    assert sorted(calls) == ["scenario_metrics", "scenario_tables"] and found.count() == rows
