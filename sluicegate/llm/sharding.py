"""Rendezvous (highest random weight) sharding of records by a stable key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.ranks import number_within

UNIT = float(1 << 53)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the highest score for ``key``; scores are ``-weight / ln(u)`` with u drawn from (key, shard).

    A shard's score depends on nothing but the key and that shard, so a shard that is added takes rows only
    into itself, and one that is removed gives up only its own. Shares follow the weights. A null key has
    scores of its own and lies in one shard. Equal scores go to the larger shard number.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need positive weights")

    def score(shard: int, weight: float) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        return -F.lit(float(weight)) / F.log((drawn.cast("double") + 0.5) / UNIT)

    scored = [F.struct(score(s, w).alias("score"), F.lit(int(s)).alias("shard")) for s, w in sorted(weights.items())]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def place(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, without bringing a shard into one task."""
    return number_within(rows, shard, slot)


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard below ``path``, in as many files as there are tasks."""
    rows.write.partitionBy(shard).parquet(path)


def sharded_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every row.

    The law is ``key``: doc_id and the number of shards decide. Size is the text's UTF-8 bytes plus 1; a null
    text counts as empty. Rows that repeat a doc_id share its shard and have slots of their own; so do rows
    with a null doc_id. Other columns of ``docs`` are ignored.
    """
    key, body = F.col(doc_id).cast("bigint"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    equal = {s: 1.0 for s in range(shards + 1)}
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, {s: equal[s] for s in range(shards)}).alias("shard"),
        rendezvous(key, equal).alias("grown_shard"),
    )
    return place(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
