"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A directory has at most 2 ** MAX_DEPTH slots, so its broadcast is bounded; buckets at that depth stay overfull.
MAX_DEPTH = 16
BUCKET_KEYS = 20_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty. ``lower`` does that by itself for ASCII texts."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(body) == F.length(body)
    return F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def slot_of(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def build_directory(keys: DataFrame, capacity: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """slot, bucket, depth of an extendible-hash directory over the distinct 64-bit values of ``key``.

    It starts as deep as evenly spread keys need. While a bucket holds more than ``capacity`` distinct keys,
    the directory doubles and only overfull buckets split; the others keep one bucket behind several slots.
    A bucket's number is its first slot. Copies of a key never split a bucket. An empty table has one slot.
    """
    spark = keys.sparkSession
    distinct = settle(keys.select("key").distinct())
    n = distinct.count()
    depth = min(max_depth, max(0, ceil(log2(max(n, 1) / capacity))))
    counts = {r[0]: r[1] for r in distinct.groupBy(slot_of(F.col("key"), depth)).count().collect()}
    buckets = {slot: (depth, counts.get(slot, 0)) for slot in range(1 << depth)}
    while depth < max_depth and any(own == depth and size > capacity for own, size in buckets.values()):
        overfull = [s for s, (own, size) in buckets.items() if own == depth and size > capacity]
        within = distinct.where(slot_of(F.col("key"), depth).isin(overfull))
        halves = {r[0]: r[1] for r in within.groupBy(slot_of(F.col("key"), depth + 1)).count().collect()}
        doubled = {}
        for slot, (own, size) in buckets.items():
            split = own == depth and size > capacity
            for child in (2 * slot, 2 * slot + 1):
                if split:
                    doubled[child] = (depth + 1, halves.get(child, 0))
                elif child == 2 * slot:
                    doubled[child] = (own, size)
        buckets, depth = doubled, depth + 1
    rows = [(slot + i, slot, own) for slot, (own, _) in buckets.items() for i in range(1 << (depth - own))]
    return spark.createDataFrame(rows, "slot bigint, bucket bigint, depth int")


def directory_depth(directory: DataFrame) -> int:
    return directory.agg(F.max("depth")).first()[0]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    norm = ascii_lower(F.col(text))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))


def build_index(records: DataFrame, directory: DataFrame) -> DataFrame:
    """Index entries on shared files: bucket, key, chain, digest, keep_id, group_size; one per distinct text.

    Texts are grouped by their bytes, copies of one text first within each task. Texts that differ but share
    a key are chained: they have chain numbers 0, 1, ... within the key. Each owner task sorts and writes
    one range of (bucket, key).
    """
    depth = directory_depth(directory)
    owned = records.withColumn("slot", slot_of(F.col("key"), depth)).join(F.broadcast(directory), "slot")
    texts = owned.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slim = texts.select("bucket", "key", F.sha2("norm", 256).alias("digest"), "keep_id", "group_size")
    ranges = slim.repartitionByRange("bucket", "key")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")) - 1
    return settle(ranges.withColumn("chain", chain))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when their bytes are, after lower-casing A-Z; a null text is the empty one. keep_id is
    the largest doc_id of the group. Rows that repeat both doc_id and text are one document and share its
    fate, so all of them are kept or none. A null doc_id is smaller than any other: such a row is kept only
    if its whole group has none. Other columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    records = keyed(docs, doc_id, text)
    slim = settle(records.select("doc_id", "key", F.sha2("norm", 256).alias("digest")))
    index = build_index(records, build_directory(slim, capacity))
    entries = index.select("key", "digest", "keep_id", "group_size")
    return slim.join(entries, ["key", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Only groups of two or more have rows to drop, so documents meet the list of dropped (doc_id, digest)
    pairs alone. Rows that repeat both doc_id and text stay together.
    """
    groups = exact_groups(docs, doc_id, text, capacity)
    dropped = groups.where(~F.col("kept")).select(
        F.col("doc_id").alias("dropped_doc_id"), F.col("text_sha256").alias("dropped_digest")
    )
    same = docs[doc_id].cast("bigint").eqNullSafe(F.col("dropped_doc_id")) & (
        F.sha2(ascii_lower(docs[text]), 256) == F.col("dropped_digest")
    )
    return docs.join(dropped.distinct(), same, "left_anti")
