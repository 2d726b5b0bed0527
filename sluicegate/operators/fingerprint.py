"""Table fingerprints that do not depend on row order, partitioning or column order.

Every row gets a SHA-256 digest; the digests are added up lane by lane, so copies count, partial
sums merge in any order, and nothing is sorted. A table's hash is the SHA-256 of count and lane sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.functions.hashing import LANES, lane, row_text

_DIGEST = "__digest"
_HALF = 30
_PART, _PARTS = 20, 3


def lane_sums() -> list[Column]:
    """Aggregates for a table that carries a row digest: each lane in parts, which add up in plain longs.

    Parts of 20 bits overflow no long below 2 ** 43 rows, and beyond that the sum is an error.
    """
    mask = F.lit(2**_PART - 1)
    return [
        F.sum(F.shiftright(lane(F.col(_DIGEST), i), _PART * part).bitwiseAND(mask)).alias(f"lane_{i}_{part}")
        for i in range(LANES)
        for part in range(_PARTS)
    ]


def lane_totals() -> list[Column]:
    """The lanes' sums as decimals, from the columns of :func:`lane_sums`."""
    out = []
    for i in range(LANES):
        parts = [F.coalesce(F.col(f"lane_{i}_{part}"), F.lit(0)).cast("decimal(20,0)") for part in range(_PARTS)]
        whole = sum((p * F.lit(2 ** (_PART * n)).cast("decimal(13,0)") for n, p in enumerate(parts[1:], 1)), parts[0])
        out.append(whole.cast("decimal(38,0)").alias(f"lane_{i}"))
    return out


def combine(n_rows: Column, lanes: list[Column] | None = None) -> Column:
    """The table's hash from its row count and the lanes' sums (by default the columns ``lane_0`` and on)."""
    found = [F.col(f"lane_{i}") for i in range(LANES)] if lanes is None else lanes
    parts = [F.coalesce(c.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) for c in found]
    return F.sha2(F.concat_ws("~", n_rows.cast("string"), *[p.cast("string") for p in parts]), 256)


def with_digest(
    df: DataFrame,
    columns: list[str] | None = None,
    float_scale: int | None = None,
    keep_column_order: bool = False,
) -> DataFrame:
    return df.withColumn(_DIGEST, F.sha2(row_text(df, columns, float_scale, keep_column_order), 256))


def fingerprint(
    df: DataFrame,
    by: list[str] | None = None,
    columns: list[str] | None = None,
    float_scale: int | None = None,
    keep_column_order: bool = False,
) -> DataFrame:
    """(by..., n_rows, fingerprint): one row, or one per group."""
    keys = by or []
    digested = with_digest(df, columns, float_scale, keep_column_order)
    # Per task, half lanes add up in plain longs; only these few rows become decimals.
    numbered = digested.select(
        *keys,
        F.spark_partition_id().alias("__task"),
        *[lane(F.col(_DIGEST), i).alias(f"lane_{i}") for i in range(LANES)],
    )
    halves = []
    for i in range(LANES):
        halves.append(F.sum(F.shiftright(f"lane_{i}", _HALF)).alias(f"high_{i}"))
        halves.append(F.sum(F.col(f"lane_{i}").bitwiseAND(F.lit(2**_HALF - 1))).alias(f"low_{i}"))
    per_task = numbered.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("n"), *halves)
    sums = per_task.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        *[
            (
                F.sum(F.col(f"high_{i}").cast("decimal(20,0)")) * F.lit(2**_HALF).cast("decimal(11,0)")
                + F.sum(F.col(f"low_{i}").cast("decimal(20,0)"))
            ).alias(f"lane_{i}")
            for i in range(LANES)
        ],
    )
    return sums.select(*(by or []), "n_rows", combine(F.col("n_rows")).alias("fingerprint"))


def file_fingerprints(spark, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of the bytes of every file below ``path``: (path, n_bytes, fingerprint).

    Each file is read as one value, so none may exceed 2 GB; ``manifest.file_digests`` takes files of any size.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("fingerprint"))


def vector_fingerprint(df: DataFrame, index: str, value: str, float_scale: int | None = None) -> DataFrame:
    """Fingerprint of an ordered vector: the position is part of each digest."""
    return fingerprint(df.select(index, value), float_scale=float_scale)


def verify(df: DataFrame, expected: Column | str, float_scale: int | None = None) -> DataFrame:
    """(expected, actual, matches) in one row."""
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    return fingerprint(df, float_scale=float_scale).select(
        wanted.alias("expected"),
        F.col("fingerprint").alias("actual"),
        (wanted == F.col("fingerprint")).alias("matches"),
    )
