"""Bounds on what one task or the driver holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sluicegate.llm import quality, simhash
from sluicegate.llm.components import components


def test_an_overfull_cell_is_shared_and_loses_no_link(llm):
    rng = np.random.default_rng(3)
    prints = {0}
    for _ in range(400):  # one dense group a few bits wide
        prints.add(sum(1 << int(b) for b in rng.choice(12, rng.integers(1, 5), replace=False)))
    prints = sorted(prints)
    df = llm.createDataFrame([(p,) for p in prints], "fp bigint").repartition(3)
    points = simhash.vantage_points(df, 3)
    blocks = simhash.overfull(df, points, 20)
    members = simhash.to_shards(df, points, simhash.RADIUS, blocks).where("NOT asks").groupBy("cell", "block").count()
    assert blocks and members.agg(F.sum("count")).first()[0] == len(prints) and members.agg(F.max("count")).first()[0] < 60
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, most=20)).collect()}
    whole = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    assert roots == whole and len(whole) > 200


def test_rows_that_repeat_a_sampled_document_are_not_collected(llm, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda positive, unlabelled: (len(positive), len(unlabelled)))
    docs = llm.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    again = llm.range(500).select(F.lit(0).cast("bigint").alias("doc_id"), F.concat(F.lit("copy "), F.col("id")).alias("text"))
    again = again.union(again.withColumn("doc_id", F.lit(2).cast("bigint"))).union(again.withColumn("doc_id", F.lit(3).cast("bigint")))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.train(docs.union(again), labels) == quality.train(docs, labels)
