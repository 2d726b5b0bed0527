"""The registered queries of the subpackage: each runs one operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import (
    bpe,
    exact_index,
    fill_middle,
    neighbours,
    packing,
    phrases,
    quality,
    secrets,
    sharding,
    simhash,
    token_files,
    warc,
    whitening,
)
from sluicegate.llm.shipping import ready
from sluicegate.session import settle, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_pack(spark, sf_dir):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(read(spark, sf_dir, "documents"), vocabulary)
    # Stored, so that a task has one Python worker: that which numbers the rows would be a second one beside the tokenizer's.
    return packing.pack(settle(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))))


@query
def op7_shards(spark, sf_dir):
    return sharding.sharded_documents(read(spark, sf_dir, "documents"))


@query
def op4_warc(spark, sf_dir):
    rows = warc.with_revisits(read(spark, sf_dir, "pages"))
    manifest = warc.write_archives(rows, warc.archive_folder(spark))
    found = warc.read_archives(spark, manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_index.exact_groups(read(spark, sf_dir, "documents"))


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_groups(read(spark, sf_dir, "documents"))


@query
def op1_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_substring_dedup(spark, sf_dir):
    found = phrases.drop_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_secrets(spark, sf_dir):
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


@query
def op8_neighbours(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


@query
def op10_quality(spark, sf_dir):
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_token_files(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_tokens(read(spark, sf_dir, "documents"), vocabulary, token_files.token_folder(shared_dir(spark)))
    found = token_files.read_tokens(spark, manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_whitening(spark, sf_dir):
    """``deviation`` is null where it passes a long's range; ``deviation_exact`` has it all the same."""
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    exact = F.col("deviation")
    return found.select(
        "vec_id", "component", "n", exact.try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error", exact.alias("deviation_exact")
    )


@query
def op13_fill_middle(spark, sf_dir):
    found = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
