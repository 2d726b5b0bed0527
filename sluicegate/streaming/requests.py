"""Streams of scoring requests: quarantine and scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.operators import boosting
from sluicegate.operators.rules import Rule, with_violations
from sluicegate.session import shared_dir


def read_files(spark, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A file stream with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def append_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files, exactly once, until the available input is used up."""
    return (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def quarantine_stream(requests: DataFrame, rules: list[Rule], path: str, checkpoint: str) -> StreamingQuery:
    """Write every request with its ``violations``, in one pass, partitioned by verdict.

    Readers of ``verdict=accepted`` and ``verdict=rejected`` each see only their part.
    """
    judged = with_violations(requests, rules)
    verdict = F.when(F.size("violations") == 0, "accepted").otherwise("rejected")
    return (
        judged.withColumn("verdict", verdict)
        .writeStream.format("parquet")
        .partitionBy("verdict")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_rows(scored: DataFrame, version: str, request_id: Column, at: Column) -> DataFrame:
    """Scored rows in the order of the prediction log; predictions stay unrounded."""
    rest = [c for c in scored.columns if c != boosting.PREDICTION]
    return scored.select(
        at.alias("timestamp"),
        request_id.alias("request_id"),
        F.lit(version).alias("model_version"),
        F.col(boosting.PREDICTION),
        *rest,
    )


def score_stream(
    requests: DataFrame, model: PipelineModel, version: str, request_id: Column, path: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Score a stream into the prediction log."""
    scored = boosting.score(model, requests)
    logged = log_rows(scored, version, request_id, F.current_timestamp())
    return append_files(logged, path, checkpoint or shared_dir(requests.sparkSession))
