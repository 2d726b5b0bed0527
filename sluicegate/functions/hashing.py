"""Order-free row text, digests and hash-based uniforms.

``float_scale=None`` writes doubles in their shortest exact form. A number writes them as integers
of that many decimals, a form other SQL engines reproduce.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4
LANE_HEX = 15


def quoted(name: str) -> str:
    """A column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cell_text(field: T.StructField, float_scale: int | None) -> str:
    """SQL for one cell. Text carries its length, so that no content can pass for another cell."""
    c = quoted(field.name)
    kind = field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if float_scale is None:
            return f"cast({c} AS string)"
        return f"cast(floor({c} * {10**float_scale}D + 0.5D) AS string)"
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return f"cast(unix_micros(cast({c} AS timestamp)) AS string)"
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return f"cast({c} AS string)"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        c = f"to_json({c})"
    elif isinstance(kind, T.BinaryType):
        c = f"hex({c})"
    else:
        c = f"cast({c} AS string)"
    return f"concat(length({c}), ':', {c})"


def row_text(
    df: DataFrame,
    columns: list[str] | None = None,
    float_scale: int | None = None,
    keep_column_order: bool = False,
) -> Column:
    """One string per row, with every cell under its column name, so no two different rows share a
    text. A NULL is written as no number or length can be."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not keep_column_order:
        fields = sorted(fields, key=lambda f: f.name)
    cells = [f"concat({literal(f.name + ':')}, coalesce({cell_text(f, float_scale)}, '~'))" for f in fields]
    return F.expr(f"concat_ws('|', {', '.join(cells)})")


def lane(digest: Column, i: int) -> Column:
    """Lane ``i`` of a hex digest: 60 bits as a number."""
    return F.conv(F.substring(digest, LANE_HEX * i + 1, LANE_HEX), 16, 10).cast("bigint")


def wide_hash(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes of the row for grouping equal rows; NULL positions are hashed too,
    because ``xxhash64`` itself skips NULLs."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    cells = []
    for field in fields:
        c = F.col(quoted(field.name))
        cells += [c.isNull(), F.to_json(c) if isinstance(field.dataType, T.MapType) else c]
    return [F.xxhash64(*cells).alias("hash_a"), F.xxhash64(F.lit(0x9E3779B9), *cells).alias("hash_b")]


DRAWS = 1 << 60  # fifteen hex digits


def _draw_sql(key: str, salt: str, seed: int) -> str:
    """Fifteen hex digits fixed by (key, salt, seed)."""
    return f"substring(md5(concat_ws('~', {key}, {literal(salt)}, '{seed}')), 1, 15)"


def _uniform_sql(key: str, salt: str, seed: int) -> str:
    return f"((cast(conv({_draw_sql(key, salt, seed)}, 16, 10) AS double) + 1.0D) / {float(DRAWS)!r}D)"


def drawn_below(key: str, salt: str, seed: int, share: float) -> Column:
    """``uniform(key, salt, seed) < share``, decided on the hex digits without converting them."""
    limit = math.ceil(Fraction(share) * DRAWS - 1)
    if limit <= 0:
        return F.lit(False)
    if limit >= DRAWS:
        return F.lit(True)
    return F.expr(f"{_draw_sql(key, salt, seed)} < '{limit:015x}'")


def uniform(key: str, salt: str, seed: int) -> Column:
    """A number in (0, 1] fixed by (key, salt, seed): the same under any partitioning.

    ``key`` is SQL for a string.
    """
    return F.expr(_uniform_sql(key, salt, seed))


def standard_normal(key: str, salt: str, seed: int) -> Column:
    """Box-Muller on two hash uniforms."""
    radius, angle = _uniform_sql(key, salt + ":r", seed), _uniform_sql(key, salt + ":a", seed)
    return F.expr(f"sqrt(-2.0D * ln({radius})) * cos(2.0D * pi() * {angle})")
