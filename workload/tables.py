"""Declared readers for the test tables and the sales view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.schema import normalise
from sluicegate.session import pin_session
from sluicegate.streaming.requests import read_files

# Digits that both engines write doubles with when rows are hashed.
SCALE = 6

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
TRAIN_END, VALIDATION_END, TEST_END = "1999-06-30", "2000-06-30", "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_session(spark)
    return normalise(spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet"))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's file as a stream."""
    pin_session(spark)
    return normalise(read_files(spark, f"{sf_dir}/{name}*.parquet", SCHEMAS[name]))


def sales(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The canonical 12-column sales table, derived from line items (or a stream of them) and parts."""
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "date_trunc('day', l_shipdate) AS date",
        "concat('store_', lpad(cast(l_suppkey % 20 AS string), 3, '0')) AS store_id",
        "CASE p_type WHEN 'PROMO' THEN 'Electronics' WHEN 'MEDIUM' THEN 'Clothing' WHEN 'ECONOMY' THEN 'Food' "
        "WHEN 'SMALL' THEN 'Sports' ELSE 'Home' END AS product_category",
        "CASE WHEN l_discount >= 0.08D THEN 1 ELSE 0 END AS promotion_flag",
        "p_retailprice AS price",
        "cast((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 500 AS double) AS inventory_level",
        "p_retailprice * (1 - l_discount) * (1 + l_tax) AS competitor_price",
        "15 + 15 * sin(2 * pi() * dayofyear(l_shipdate) / 365) + (l_quantity - 25.5D) / 5 AS temperature",
        "cast(weekday(l_shipdate) AS int) AS day_of_week",
        "cast(month(l_shipdate) AS int) AS month",
        "l_quantity * l_linenumber AS previous_day_sales",
        "greatest(0.0D, 100 + 30 * (CASE WHEN l_discount >= 0.08D THEN 1 ELSE 0 END) + (l_quantity - 25.5D) "
        "+ 0.1D * (l_quantity * l_linenumber)) AS sales_demand",
    )
