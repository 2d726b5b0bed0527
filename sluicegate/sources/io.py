"""Readers and writers with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate import contract
from sluicegate.operators import fingerprint as fp
from sluicegate.schema import normalise

FORMATS = {".parquet": "parquet", ".csv": "csv"}


def _format_of(path: str) -> str:
    for suffix, name in FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return name
    raise ValueError(f"unsupported file format: {path}")


def load_dataset(
    spark: SparkSession, path: str, schema: T.StructType | None = contract.SALES_SCHEMA, expected: str | None = None
) -> DataFrame:
    """Read Parquet or CSV by suffix, with a declared schema. A missing path is an error.

    With ``expected``, the data is fingerprinted first and a mismatch raises.
    """
    reader = spark.read.format(_format_of(path))
    if schema is not None:
        reader = reader.schema(schema)
    if _format_of(path) == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
    df = normalise(reader.load(path))
    if expected is not None:
        found = fp.fingerprint(df).first()["fingerprint"]
        if found != expected:
            raise ValueError(f"fingerprint mismatch for {path}: expected {expected}, found {found}")
    return df


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every cell as text, for rules that judge whether cells convert; ``schema.conform`` types it."""
    return spark.read.format("csv").option("header", "true").load(path)


def lineage(df: DataFrame, source: str, float_scale: int | None = None) -> DataFrame:
    """(source, n_rows, n_columns, column_names, fingerprint)."""
    return fp.fingerprint(df, float_scale=float_scale).select(
        F.lit(source).alias("source"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        "fingerprint",
    )


def save_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write Parquet or CSV by suffix and return the lineage row of what was written."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    fmt = _format_of(path)
    writer.option("header", "true").format(fmt).save(path)
    written = df.sparkSession.read.schema(df.schema).format(fmt).option("header", "true").load(path)
    return lineage(written.select(*df.columns), path)


def save_result_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result table as one CSV file, with its columns in name order."""
    df.select(*sorted(df.columns)).repartition(1).write.mode(mode).option("header", "true").csv(path)


def save_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table as JSON lines; timestamps in ISO form."""
    df.write.mode(mode).json(path)
