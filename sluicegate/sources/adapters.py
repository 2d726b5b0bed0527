"""Adapters that bring other demand tables to the canonical sales columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.operators.ordered import lag_in_order


def calendar_features(df: DataFrame, timestamp: str) -> DataFrame:
    """Add ``date`` (floored to the day), ``day_of_week`` (0 = Monday) and ``month``."""
    return df.withColumns(
        {
            "date": F.date_trunc("day", timestamp),
            "day_of_week": F.weekday(timestamp).cast("int"),
            "month": F.month(timestamp).cast("int"),
        }
    )


def to_contract(df: DataFrame) -> DataFrame:
    """Canonical columns, order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.SALES_SCHEMA])


def adapt_transactions(
    df: DataFrame, timestamp: str, store: str, quantity: str, unit_price: str, category: str = "retail"
) -> DataFrame:
    """Daily demand per store from sales transactions with positive quantity and price.

    ``previous_day_sales`` is the store's previous day that has sales, 0 on its first.
    """
    kept = df.where((F.col(quantity) > 0) & (F.col(unit_price) > 0)).where(
        F.col(timestamp).isNotNull() & F.col(store).isNotNull()
    )
    daily = kept.groupBy(F.date_trunc("day", timestamp).alias("date"), F.col(store).cast("string").alias("store_id")).agg(
        F.sum(F.col(quantity) * F.col(unit_price)).alias("sales_demand"),
        F.avg(unit_price).alias("price"),
        F.sum(quantity).alias("inventory_level"),
    )
    lagged = lag_in_order(
        daily, "sales_demand", "date", "previous_day_sales", ["store_id"], bucket=F.year("date")
    )
    return to_contract(
        calendar_features(lagged, "date").withColumns(
            {
                "product_category": F.lit(category),
                "promotion_flag": F.lit(0),
                "competitor_price": F.col("price"),
                "temperature": F.lit(0.0),
            }
        )
    )


def adapt_hourly(
    df: DataFrame,
    day: str,
    hour: str,
    category: str,
    holiday: str,
    temperature: str,
    count: str,
    store: str = "hourly",
    weekday: Column | None = None,
    month: Column | None = None,
) -> DataFrame:
    """Hourly demand. Time is day plus hour; ``previous_day_sales`` is the previous existing hour.

    Weekday and month come from the timestamp unless given.
    """
    at = F.timestamp_add("HOUR", F.col(hour), F.to_timestamp(F.col(day)))
    timed = df.withColumn("date", at)
    lagged = lag_in_order(timed, count, "date", "previous_day_sales", bucket=F.date_trunc("month", "date"))
    return to_contract(
        lagged.select(
            "date",
            F.lit(store).alias("store_id"),
            F.col(category).cast("string").alias("product_category"),
            F.col(holiday).alias("promotion_flag"),
            F.lit(1.0).alias("price"),
            F.col(count).alias("inventory_level"),
            F.lit(1.0).alias("competitor_price"),
            F.col(temperature).alias("temperature"),
            (F.weekday("date") if weekday is None else weekday).alias("day_of_week"),
            (F.month("date") if month is None else month).alias("month"),
            "previous_day_sales",
            F.col(count).alias("sales_demand"),
        )
    )
