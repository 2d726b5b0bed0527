"""Byte-level BPE: every distinct pre-token is encoded once, wherever it stands."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Text gathered in one block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of words: about 1 MB of distinct words and positions.
BUCKET_BYTES = 8 << 20
WORDS = "bucket bigint, block bigint, words binary, lengths binary, proof bigint"
PARTS = "block bigint, bucket bigint, proof bigint, ids binary, sizes binary, places binary"
U4 = np.dtype("<u4")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file as a dictionary; a vocabulary is bounded, about 50,000 entries."""
    rows = (line.split() for line in open(path, "rb") if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def pack_varints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2 ** 35 as little-endian base-128 numbers."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    for i in range(5):
        has = sizes > i
        out[first[has] + i] = ((values[has] >> np.uint64(7 * i)) & np.uint64(127)) | np.where(sizes[has] > i + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def unpack_varints(data: bytes) -> np.ndarray:
    octets = np.frombuffer(data, dtype=np.uint8)
    if not len(octets):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(octets < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    within = np.arange(len(octets)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((octets & 127).astype(np.int64) << (7 * within), first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_bytes: int) -> Iterator[tuple[int, list, list, list]]:
    """number, doc_ids, pre-tokens per document and pre-tokens of every block of one scan task.

    The number is a hash of the block's documents, so both reads give it, and so does a task that runs again.
    """
    find = regex.compile(pattern).findall
    keys, counts, words, held, number = [], [], [], 0, xxhash.xxh64()
    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            key, text = key.as_py(), text.as_py()
            found = find(text) if text else []
            keys.append(key)
            counts.append(len(found))
            words += found
            held += len(text or "") + 64
            number.update(f"{key},{len(text or '')}:{text or ''}")
            if held >= block_bytes:
                yield number.intdigest() >> 1, keys, counts, words
                keys, counts, words, held, number = [], [], [], 0, xxhash.xxh64()
    if keys:
        yield number.intdigest() >> 1, keys, counts, words


def _homes(raw: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of a block's distinct words, and which words lie in each."""
    home = np.fromiter(map(xxhash.xxh32_intdigest, raw), dtype=np.int64, count=len(raw)) % buckets
    order = np.argsort(home, kind="stable")
    if len(raw):
        for some in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            yield int(home[some[0]]), some


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def explode_words(docs: DataFrame, pattern: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The distinct pre-tokens of every block, by bucket: what a block repeats moves once.

    A block is a run of documents of one task. ``proof`` is a hash of the words, which their positions carry too.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for block, _, _, words in _blocks(batches, pattern, block_bytes):
            raw = [w.encode() for w in dict.fromkeys(words)]
            out = []
            for home, some in _homes(raw, buckets):
                own = [raw[i] for i in some.tolist()]
                joined, lengths = b"".join(own), pack_varints(np.array([len(w) for w in own]))
                out.append((home, block, squeeze(joined), squeeze(lengths), proof_of(joined, lengths)))
            yield _columns(out, WORDS)

    return docs.mapInArrow(split, WORDS)


def proof_of(words: bytes, lengths: bytes) -> int:
    return xxhash.xxh64_intdigest(words + lengths) >> 1


def explode_places(docs: DataFrame, pattern: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positions of every block's pre-tokens, as ``explode_words`` orders them, and a header per block (bucket -1).

    They go straight to where the block is put together, while its words go by way of their buckets.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for block, keys, counts, words in _blocks(batches, pattern, block_bytes):
            index: dict[str, int] = {}
            code = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(code, kind="stable")
            freq = np.bincount(code, minlength=len(index))
            ends = np.cumsum(freq)
            raw = [w.encode() for w in index]
            known = np.array([k is not None for k in keys], dtype=np.uint8).tobytes()
            ids = np.array([k or 0 for k in keys], dtype="<i8").tobytes()
            out = [(block, -1, 0, None, squeeze(known + ids), squeeze(pack_varints(np.array(counts, dtype=np.int64))))]
            for home, some in _homes(raw, buckets):
                places = order[ragged(ends[some] - freq[some], freq[some])]
                first = np.cumsum(freq[some]) - freq[some]
                gaps = np.diff(places, prepend=0)
                gaps[first] = places[first]
                own = [raw[i] for i in some.tolist()]
                proof = proof_of(b"".join(own), pack_varints(np.array([len(w) for w in own])))
                out.append((block, home, proof, None, None, squeeze(pack_varints(freq[some]) + pack_varints(gaps))))
            yield _columns(out, PARTS)

    return docs.mapInArrow(split, PARTS)


def encode_words(moved: DataFrame, pattern: str, ranks: Broadcast) -> DataFrame:
    """Buckets of words to buckets of ids: each distinct word of a bucket, that is of all documents, once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        squeeze, restore = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        bucket, known = None, {}
        for batch in batches:
            out = []
            for own, block, words, lengths, proof in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words", "lengths", "proof")), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                words = restore(words)
                ends = np.cumsum(unpack_varints(restore(lengths))).tolist()
                coded = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = words[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(one(word.decode()), dtype=U4).tobytes()
                    coded.append(found)
                sizes = pack_varints(np.array([len(c) // 4 for c in coded], dtype=np.int64))
                out.append((block, own, proof, squeeze(pack_varints(np.frombuffer(b"".join(coded), U4))), squeeze(sizes), None))
            yield _columns(out, PARTS)

    return moved.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, PARTS)


def _assemble(rows: list[tuple]) -> Iterator[tuple[int | None, bytes]]:
    """The documents of one block from its header, its words' ids and their positions.

    Blocks of equal documents have one number: they are put together once and given as often as they have headers.
    """
    restore = zstandard.ZstdDecompressor().decompress
    keys, counts, times = [], [], 0
    coded, placed = {}, {}
    for bucket, proof, ids, sizes, places in rows:
        if bucket < 0:
            times += 1
            counts = unpack_varints(restore(places))
            n, own = len(counts), restore(sizes)
            keys = [int(k) if has else None for has, k in zip(own[:n], np.frombuffer(own[n:], "<i8"), strict=True)]
        elif places is None:
            coded[bucket] = (proof, unpack_varints(restore(ids)).astype(U4), unpack_varints(restore(sizes)))
        else:
            placed[bucket] = (proof, unpack_varints(restore(places)))
    if {b: x[0] for b, x in coded.items()} != {b: x[0] for b, x in placed.items()}:
        raise ValueError("documents changed between two reads of them; store them first")
    at = np.empty(int(sum(counts)), dtype=np.int64)
    flat, size, words = [np.zeros(0, dtype=U4)], [np.zeros(0, dtype=np.int64)], 0
    for bucket, (_, ids, own) in coded.items():
        numbers = placed[bucket][1]
        freq, gaps = numbers[: len(own)], numbers[len(own) :]
        first = np.cumsum(freq) - freq
        run = np.cumsum(gaps)
        at[run - np.repeat(run[first] - gaps[first], freq)] = words + np.repeat(np.arange(len(own)), freq)
        flat.append(ids)
        size.append(own)
        words += len(own)
    size = np.concatenate(size)
    lengths = size[at]
    joined = np.concatenate(flat)[ragged((np.cumsum(size) - size)[at], lengths)]
    token_ends = np.concatenate(([0], np.cumsum(lengths)))
    ends = token_ends[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
    for key, a, b in zip(keys * times, ends[:-1].tolist() * times, ends[1:].tolist() * times, strict=True):
        yield key, joined[a:b].tobytes()


def assemble(parts: DataFrame) -> DataFrame:
    """doc_id and ids of every document; a block is put together by one task that holds it alone."""
    schema = "doc_id bigint, ids binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            out, held = [], 0
            for found in _assemble(rows) if rows else ():
                out.append(found)
                held += len(found[1])
                if held > 8 << 20:
                    yield _columns(out, schema)
                    out, held = [], 0
            if out:
                yield _columns(out, schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "bucket", "proof", "ids", "sizes", "places"))
            for own, *row in zip(*columns, strict=True):
                if own != block:
                    yield from done()
                    block, rows = own, []
                rows.append(tuple(row))
        yield from done()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(build, schema)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row, by the ranks at ``path``.

    Each match of ``pattern`` is encoded separately, without special tokens. A null text counts as empty;
    an empty text has no ids. Null and repeated doc_ids are carried row by row; other columns are ignored.
    ``docs`` is read twice, for its words and for their positions. So it should be a stored table or derive
    from one row by row; a difference between the two reads is an error.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranks = spark.sparkContext.broadcast(read_ranks(spark, path))
    buckets = max(1, -(-size // bucket_bytes))
    coded = encode_words(explode_words(slim, pattern, buckets, block_bytes), pattern, ranks)
    return assemble(coded.union(explode_places(slim, pattern, buckets, block_bytes)))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (bytes) of rows with doc_id and ids; null ids give null, unknown ids are an error.

    Ids join the table of token bytes inside each task; that table is the vocabulary, which is bounded.
    """
    spark = coded.sparkSession
    table = spark.sparkContext.broadcast({i: token for token, i in read_ranks(spark, path).items()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = table.value.__getitem__
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            found = [None if x is None else b"".join(map(token, np.frombuffer(x, U4).tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(join, "doc_id bigint, ids binary, decoded binary")
