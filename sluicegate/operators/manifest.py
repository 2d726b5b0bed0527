"""Digests of files: an additive tree over a table's files, and chunked digests of files of any size.

The lane sums of a table's files add up to those of their folders and of the table. So a stored manifest tells which
files differ, and only files that are new or were written again are read for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate.functions.hashing import LANES
from sluicegate.operators.fingerprint import combine, lane_sums, lane_totals, with_digest
from sluicegate.schema import normalise

LANE_NAMES = [f"lane_{i}" for i in range(LANES)]
MANIFEST_COLUMNS = ["file", "folder", "n_bytes", "modified", "n_rows", *LANE_NAMES]
FILE = "__manifest_file"
#: Bytes of a file that are held at a time.
CHUNK = 8 << 20
DIGESTS = "path string, n_bytes bigint, fingerprint string"


def listed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, n_bytes, modified) of every file below ``path``; no content is read. Files without a byte are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    about = F.col("_metadata")
    return found.select(about["file_path"].alias("file"), about["file_size"].alias("n_bytes"), about["file_modification_time"].alias("modified"))


def _file_lanes(spark: SparkSession, path: str, schema: T.StructType, files: list[str] | None, fmt: str, float_scale: int | None) -> DataFrame:
    """(file, n_rows, lanes) of a table's files, or of some of them."""
    read = spark.read.schema(schema).format(fmt).option("basePath", path).load(path if files is None else files)
    rows = normalise(read.select("*", F.col("_metadata.file_path").alias(FILE)))
    digested = with_digest(rows, schema.fieldNames(), float_scale)
    one = digested.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *lane_sums())
    return one.select("file", "n_rows", *lane_totals())


def file_manifest(
    spark: SparkSession, path: str, schema: T.StructType, previous: DataFrame | None = None, fmt: str = "parquet", float_scale: int | None = None
) -> DataFrame:
    """One row per file of the table at ``path``: file, folder (below ``path``), n_bytes, modified, n_rows and lane sums.

    ``schema`` has the partition columns too; their values are part of the rows' digests. Files that ``previous`` has
    with the same size and time are taken from there, and only the others are read; their names pass through the driver.
    A file without rows has zero lanes.
    """
    files = listed_files(spark, path, f"*.{fmt}")
    known, fresh = None, None
    if previous is not None:
        same = ["file", "n_bytes", "modified"]
        known = files.join(previous.select(*same, "n_rows", *LANE_NAMES), same)
        fresh = [unquote(r["file"]) for r in files.join(previous.select(*same), same, "left_anti").select("file").collect()]
    if fresh == []:
        counted = known
    else:
        own = files if fresh is None else files.join(previous.select("file", "n_bytes", "modified"), ["file", "n_bytes", "modified"], "left_anti")
        counted = own.join(_file_lanes(spark, path, schema, fresh, fmt, float_scale), "file", "left").fillna(0, ["n_rows"])
        for name in LANE_NAMES:
            counted = counted.withColumn(name, F.coalesce(name, F.lit(0).cast("decimal(38,0)")))
        counted = counted if known is None else known.unionByName(counted)
    # Names are URIs; a plus sign in one is no space.
    plain, base = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), path.rstrip("/").removeprefix("file://").removeprefix("file:")
    inside = F.substr(plain, F.instr(plain, F.lit(base)) + len(base), F.length(plain))
    folder = F.regexp_replace(F.regexp_replace(inside, "[^/]*$", ""), "^/|/$", "")
    return counted.withColumn("folder", folder).select(*MANIFEST_COLUMNS)


def added_up(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_files, n_rows, fingerprint): the lanes of files added up, which gives the fingerprint of their rows."""
    sums = manifest.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c) for c in LANE_NAMES],
    )
    return sums.select(*(by or []), "n_files", "n_rows", combine(F.col("n_rows")).alias("fingerprint"))


def compare_manifests(expected: DataFrame, actual: DataFrame, by: str = "folder") -> DataFrame:
    """(by, status, expected, actual) of every folder or file: same, changed, missing or added."""
    sides = [added_up(m, [by]).select(by, F.col("fingerprint").alias(name)) for m, name in ((expected, "expected"), (actual, "actual"))]
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "added")
        .when(F.col("expected") == F.col("actual"), "same")
        .otherwise("changed")
    )
    return sides[0].join(sides[1], by, "full").select(by, status.alias("status"), "expected", "actual")


def file_digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the bytes of every file below ``path``: (path, n_bytes, fingerprint).

    Tasks read their files in chunks, so a file of any size takes the memory of one chunk; files are spread over
    tasks by name. ``path`` must be in a file system that pyarrow opens. Files without a byte are left out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column("file").to_pylist():
                store, inner = fs.FileSystem.from_uri(name)
                told, size = hashlib.sha256(), 0
                with store.open_input_stream(inner, compression=None) as source:
                    while part := source.read(chunk):
                        told.update(part)
                        size += len(part)
                out.append((unquote(name), size, told.hexdigest()))
            columns = zip(*out, strict=True) if out else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "n_bytes", "fingerprint"])

    files = listed_files(spark, path, glob).select("file")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "file").mapInArrow(digest, DIGESTS)
