"""Gapless numbers within groups, however few groups there are."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate.session import settle

PART, LOCAL = "rank_part", "rank_local"


def number_within(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of the integer column ``key``.

    No group meets in one task. Each task numbers its own rows per key and the numbered rows are stored; the
    counts per task and key give every task its first number. The order within a key is that of the tasks.
    A null key is an error. The columns ``rank_part`` and ``rank_local`` are used on the way and must be free.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(LOCAL, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            column = batch.column(key)
            if column.null_count:
                raise ValueError(f"a null {key} cannot be numbered")
            values = column.to_numpy(zero_copy_only=False)
            order = np.argsort(values, kind="stable")
            found, first, sizes = np.unique(values[order], return_index=True, return_counts=True)
            local = np.empty(len(values), dtype=np.int64)
            local[order] = np.arange(len(values)) - np.repeat(first, sizes) + np.repeat([seen[k] for k in found.tolist()], sizes)
            for k, n in zip(found.tolist(), sizes.tolist(), strict=True):
                seen[k] += n
            parts = pa.array(np.full(len(values), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(local)], names)

    names = [f.name for f in schema.fields]
    stored = settle(df.mapInArrow(number, schema))
    ahead = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        stored.groupBy(key, PART)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, PART, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first_number"))
    )
    joined = stored.join(firsts, [key, PART])
    return joined.select(*df.columns, (F.col("first_number") + F.col(LOCAL)).alias(name))
