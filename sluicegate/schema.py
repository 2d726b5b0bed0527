"""The one place where missing values and timestamps are brought into a single form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluicegate.contract import SALES_SCHEMA


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, -0.0 becomes 0.0, and zone-less timestamps become session timestamps."""
    out = []
    for field in df.schema.fields:
        c = f"`{field.name}`"
        kind = field.dataType.simpleString()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"CASE WHEN NOT isnan({c}) THEN {c} + cast(0 AS {kind}) END AS {c}")
        elif isinstance(field.dataType, T.TimestampNTZType):
            out.append(f"cast({c} AS timestamp) AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def conform(df: DataFrame, schema: T.StructType = SALES_SCHEMA) -> DataFrame:
    """Project to ``schema`` in its order; a value that does not convert becomes NULL."""
    return df.selectExpr(*[f"try_cast(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema])
