"""The append-only log of scored requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate import contract

CORRUPT, DAY = "__corrupt", "log_day"
WRITTEN_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("prediction", T.DoubleType()),
        *[f for f in contract.SALES_SCHEMA if f.name not in (contract.DATE, contract.TARGET)],
    ]
)


def append_log(rows: DataFrame, path: str, timestamp: str) -> None:
    """Add JSON lines below the day they belong to; nothing already written is read or rewritten.

    Rows without a time have a folder of their own.
    """
    dated = rows.withColumn(DAY, F.date_format(timestamp, "yyyy-MM-dd"))
    dated.write.mode("append").partitionBy(DAY).option("timestampFormat", WRITTEN_TIME).json(path)


def append_predictions(events: DataFrame, path: str) -> None:
    """Add scored requests to the log of predictions, in its columns and types."""
    append_log(events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA]), path, "timestamp")


def in_range(df: DataFrame, timestamp: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive and optional."""
    out = df
    if start:
        out = out.where(F.col(timestamp) >= F.to_timestamp(F.lit(start)))
    if end:
        out = out.where(F.col(timestamp) <= F.to_timestamp(F.lit(end)))
    return out


def _lines(spark: SparkSession, path: str, start: str | None, end: str | None) -> DataFrame | None:
    """(line, log_day) of the days a range touches, and of files that lie in no day's folder; None without a log."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    # The days and loose files of a log, not the files of the days.
    found = [(f.getPath().toString(), f.isDirectory()) for f in store.listStatus(folder) if f.getPath().getName()[0] not in "._"]
    loose = [name for name, is_folder in found if not is_folder]
    parts = []
    if any(is_folder for _, is_folder in found):
        days = spark.read.schema(f"value string, {DAY} string").option("basePath", path).text(path)
        low, high = (None if x is None else str(x)[:10] for x in (start, end))
        days = days.where(F.col(DAY) >= low) if low else days
        parts.append(days.where(F.col(DAY) <= high) if high else days)
    if loose:
        parts.append(spark.read.text(loose).withColumn(DAY, F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("value", "line") if parts else None


def read_log(
    spark: SparkSession, path: str, schema: T.StructType, timestamp: str, start: str | None = None, end: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of a JSON log from ``start`` to ``end`` (inclusive and optional), and beside them the bad lines.

    Only the folders of the days in the range are read. A line that is no JSON, or whose values are not of the
    schema's types, is a row (log_day, line) of the second table and of no other; blank lines are skipped. A log
    that does not exist yet is empty.
    """
    lines = _lines(spark, path, start, end)
    if lines is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], f"{DAY} string, line string")
    typed = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("line", typed, {"columnNameOfCorruptRecord": CORRUPT})
    told = lines.where(F.trim("line") != "").withColumn("parsed", parsed)
    bad = F.col(f"parsed.{CORRUPT}").isNotNull()
    good = told.where(~bad).select(*[F.col("parsed")[f.name].alias(f.name) for f in schema])
    return in_range(good, timestamp, start, end), told.where(bad).select(DAY, "line")


def load_predictions(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The good rows of the log of predictions in a time range; :func:`corrupt_lines` lists the others."""
    return read_log(spark, path, LOG_SCHEMA, "timestamp", start, end)[0]


def corrupt_lines(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(log_day, line) of the lines of the log of predictions that are no rows."""
    return read_log(spark, path, LOG_SCHEMA, "timestamp", start, end)[1]
