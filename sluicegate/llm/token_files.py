"""Token ids in binary files: rANS blocks with checkpoints and checksums, written and read by independent tasks.

A file is MAGIC, the length and bytes of its frequency table, and blocks. A block is a head and a payload: the
directory (ids and lengths of the documents that start in it), checkpoints and words. The manifest, a stored
table with a row per block, gives readers the places where they can start.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm import rans
from sluicegate.llm.bpe import pack_varints, ragged, unpack_varints
from sluicegate.session import settle

MAGIC, MARK = b"TOKRANS1", b"BLOK"
#: mark, payload bytes, tokens, lanes, checkpoints, documents, directory bytes, crc32 of the payload, file's tokens before
HEAD = struct.Struct("<4sQIIIIIIQ")
BLOCK_TOKENS, FILE_TOKENS, SPLIT_BLOCKS = 1 << 20, 1 << 24, 2
#: Text of one writing task, and of the documents that are split into words together.
PART_BYTES, GROUP_BYTES = 32 << 20, 16 << 20
MANIFEST = "part int, file int, path string, block int, at bigint, tokens bigint, documents bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
# What byte-level files split texts by.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for ASCII texts, for the faster of two engines.
ASCII_SPLITTER = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
# Characters that are in the same classes in every Unicode version since 5.0.
SETTLED = re.compile("[\t-\r -~¡-ȳͰ-ώА-ԏ‐-‧‰-⁞ぁ-んァ-ヺ一-龥가-힣]*")


# White space before a space: such texts are split by the pattern itself.
SPACES = re.compile("[\t-\r ] ")
# The letter that byte-level files write a space with.
SPACE = "\u0120"


class ByteTokenizer:
    """Ids of texts by a byte-level BPE ``tokenizers`` file, each distinct pre-token of a group of texts once.

    The file's BPE model is given the pre-tokens of texts in settled characters. Texts with others, or with the
    content of an added token, go through the library as a whole; so do all texts of a file of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        split = told["pre_tokenizer"] or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.plain = bool(usual) and told["normalizer"] is None and not told["model"].get("ignore_merges")
        self.added = [t["content"] for t in told["added_tokens"]]
        self.find, self.find_ascii = regex.compile(SPLITTER).findall, re.compile(ASCII_SPLITTER).findall
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _simple(self, text: str) -> bool:
        return self.plain and not any(a in text for a in self.added) and SETTLED.fullmatch(text) is not None

    def _ids(self, text: str, known: dict[str, list[int]]) -> list[int]:
        """The ids of a simple text, pre-token by pre-token."""
        out: list[int] = []
        for own in self.find_ascii(text) if text.isascii() else self.find(text):
            ids = known.get(own)
            if ids is None:
                mapped = own.encode().decode("latin-1").translate(self.letters)
                ids = known[own] = [t.id for t in self.whole.model.tokenize(mapped)]
            out += ids
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the number of each.

        A space behind anything but white space begins a pre-token, so simple texts are cut before each, and each
        distinct part is encoded once; the first part of a text has no space. Texts with other spaces are taken
        pre-token by pre-token.
        """
        simple = [self._simple(t) for t in texts]
        cut = [ok and SPACES.search(t) is None for ok, t in zip(simple, texts, strict=True)]
        split = pc.split_pattern(pa.array([t if ok else "" for ok, t in zip(cut, texts, strict=True)], pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        model, letters, known = self.whole.model.tokenize, self.letters, {}
        whole = iter([e.ids for e in self.whole.encode_batch_fast([t for ok, t in zip(simple, texts, strict=True) if not ok], add_special_tokens=False)])
        flat: list[int] = []
        ends: list[int] = []
        for word in words:
            if word.isalpha():
                mapped = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                flat += [t.id for t in model(SPACE + mapped)]
            else:
                flat += self._ids(" " + word, known)
            ends.append(len(flat))
        # The first part of every text, by itself.
        code[offsets[:-1]] = np.arange(len(texts)) + len(words)
        for i, text in enumerate(texts):
            flat += self._ids(text.partition(" ")[0] if cut[i] else text, known) if simple[i] else next(whole)
            ends.append(len(flat))
        firsts = np.array([0, *ends], dtype=np.int64)
        lengths = np.diff(firsts)[code]
        ids = np.array(flat, dtype="<u4")[ragged(firsts[code], lengths)]
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[offsets])


@lru_cache(maxsize=1)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def directory(keys: list[int | None], lengths: np.ndarray) -> bytes:
    known = np.array([k is not None for k in keys], dtype=np.uint8).tobytes()
    ids = np.array([k or 0 for k in keys], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor().compress(known + ids + pack_varints(lengths))


def read_directory(data: bytes, n: int) -> tuple[list[int | None], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ids = np.frombuffer(raw[n : 9 * n], "<i8").tolist()
    return [k if has else None for has, k in zip(raw[:n], ids, strict=True)], unpack_varints(raw[9 * n :])


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, the place of every id among them, and their counts."""
    if not len(ids) or int(ids.max()) >= 1 << 24:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.uint32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def file_parts(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, block_tokens: int = BLOCK_TOKENS) -> Iterator[tuple[bytes, int, int]]:
    """Bytes, tokens and documents of the file's beginning and of each block; no documents give one block."""
    symbols, places, counts = _distinct(ids)
    table = rans.Table.of_counts(symbols, counts)
    told = table.to_bytes()
    yield MAGIC + len(told).to_bytes(4, "little") + told, 0, 0
    starts = np.cumsum(lengths) - lengths
    blocks = max(1, -(-len(ids) // block_tokens))
    # A document without tokens at the end of the file starts in the last block.
    home = np.minimum(starts // block_tokens, blocks - 1)
    cuts = np.searchsorted(home, np.arange(blocks + 1))
    for block in range(blocks):
        at, end = block * block_tokens, min(len(ids), (block + 1) * block_tokens)
        lo, hi = int(cuts[block]), int(cuts[block + 1])
        words, marks, before = rans.encode(places[at:end], table)
        # The first document's place in the block goes before the lengths.
        skip = int(starts[lo]) - at if hi > lo else 0
        listed = directory(keys[lo:hi], np.concatenate(([skip], lengths[lo:hi])))
        payload = listed + marks.tobytes() + before.tobytes() + words.tobytes()
        head = HEAD.pack(MARK, len(payload), end - at, marks.shape[1], len(marks), hi - lo, len(listed), zlib.crc32(payload), at)
        yield head + payload, end - at, hi - lo


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int | None = 2,
    part_bytes: int = PART_BYTES,
    block_tokens: int = BLOCK_TOKENS,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode all texts, in ascending doc_id order, into files below ``folder``, which all tasks must reach.

    Each task takes a range of doc_ids, encodes its texts and writes files of at least ``file_tokens`` ids but for
    its last one; the blocks of a file share the table of its ids' frequencies. ``end`` is appended to every document
    if given. Null texts count as empty, null doc_ids come first, rows that repeat a doc_id follow each other by a
    hash of their text and may lie in several ranges; other columns are ignored. The result is the manifest, a stored
    table with a row per block: files of attempts that failed are not in it. An empty table gives an empty one.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    # Equal rows are told apart by their place in the scan, so that one row's copies fill several ranges.
    keyed = slim.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    dealt = keyed.repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    last = np.array([] if end is None else [end], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, files = context.partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        tokens = byte_tokenizer(vocabulary)
        keys, texts, held = [], [], 0
        done_keys, done_lengths, done_ids, total = [], [], [], 0

        def encode() -> None:
            nonlocal keys, texts, held, total
            ids, lengths = tokens(texts)
            if len(last):
                ids = np.insert(ids, np.cumsum(lengths), last[0])
                lengths = lengths + 1
            done_keys.extend(keys)
            done_lengths.append(lengths)
            done_ids.append(ids)
            total += len(ids)
            keys, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal files, done_keys, done_lengths, done_ids, total
            name = f"tokens-{part:06d}-{files:04d}-{context.taskAttemptId()}.rans"
            rows, at = [], 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for block, (data, n, documents) in enumerate(file_parts(done_keys, np.concatenate(done_lengths), np.concatenate(done_ids), block_tokens)):
                    out.write(data)
                    if block:
                        rows.append((part, files, f"{folder}/{name}", block - 1, at, n, documents))
                    at += len(data)
            files, done_keys, done_lengths, done_ids, total = files + 1, [], [], [], 0
            return _table(rows, MANIFEST)

        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                value = value.as_py()
                keys.append(key)
                texts.append(value)
                held += len(value) + 64
                if held >= GROUP_BYTES:
                    encode()
                    if total >= file_tokens:
                        yield flush()
        if keys:
            encode()
        if done_keys:
            yield flush()

    return settle(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST))


def file_starts(manifest: DataFrame, bundle: int = 1000) -> DataFrame:
    """part, file and first: the tokens of all files before each. Sums go through bundles of parts, not through one task."""
    sized = manifest.groupBy("part", "file").agg(F.sum("tokens").alias("tokens")).withColumn("bundle", F.floor(F.col("part") / bundle))
    inside = Window.partitionBy("bundle").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(0)).orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)
    bundles = sized.groupBy("bundle").agg(F.sum("tokens").alias("tokens"))
    ahead = bundles.select("bundle", F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("ahead"))
    before = F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return sized.withColumn("before", before).join(ahead, "bundle").select("part", "file", (F.col("ahead") + F.col("before")).alias("first"))


class _File:
    """One open file: its table and blocks, each checked as it is read."""

    def __init__(self, source):
        self.source = source
        head = source.read_at(len(MAGIC) + 4, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(head[len(MAGIC) :], "little")
        self.decoder = rans.Decoder(rans.Table.from_bytes(source.read_at(size, len(MAGIC) + 4)))

    def block(self, at: int) -> tuple:
        """head fields, payload and the place of the next block."""
        head = HEAD.unpack(self.source.read_at(HEAD.size, at))
        payload = self.source.read_at(head[1], at + HEAD.size)
        if head[0] != MARK or zlib.crc32(payload) != head[7]:
            raise ValueError("a damaged block")
        return head, payload, at + HEAD.size + head[1]

    def ids(self, head: tuple, payload: bytes, first: int, last: int) -> np.ndarray:
        _, _, n, lanes, checkpoints, _, listed, _, _ = head
        marks = np.frombuffer(payload, "<u8", checkpoints * lanes, listed).reshape(checkpoints, lanes)
        before = np.frombuffer(payload, "<u4", checkpoints, listed + marks.nbytes)
        stream = np.frombuffer(payload, "<u4", -1, listed + marks.nbytes + before.nbytes)
        return self.decoder.decode(stream, marks, before, n, first, last)

    def documents(self, at: int, blocks: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the file and ids of the documents that start in ``blocks`` blocks from ``at`` on.

        Blocks after those are read as far as the last document needs them, to the checkpoint behind its end.
        """
        key, place, wanted, held = None, 0, 0, []
        for number in range(1 << 62):
            if number >= blocks and not wanted:
                break
            head, payload, at = self.block(at)
            n, begin = head[2], head[8]
            carried = min(wanted, n)
            keys, skip, lengths = [], n, np.zeros(0, dtype=np.int64)
            if number < blocks and head[5]:
                keys, told = read_directory(payload[: head[6]], head[5])
                skip, lengths = int(told[0]), told[1:]
            first = 0 if wanted else skip
            last = n if len(keys) else carried
            ids = self.ids(head, payload, first, last) if last > first else np.zeros(0, dtype="<u4")
            if wanted:
                held.append(ids[:carried])
                wanted -= carried
                if not wanted:
                    yield key, place, np.concatenate(held)
            own = skip
            for key, length in zip(keys, lengths.tolist(), strict=True):
                place = begin + own
                got = ids[own - first : min(own + length, n) - first]
                own += length
                if own <= n:
                    yield key, place, got
                else:
                    held, wanted = [got], own - n


def read_tokens(spark: SparkSession, manifest: DataFrame, split_blocks: int = SPLIT_BLOCKS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of the files in ``manifest``.

    Tasks read splits of ``split_blocks`` blocks and own the documents that start in them. Checksums of tables and
    blocks, and the lanes' last states, are verified; a damaged file is an error. An empty manifest gives no rows.
    """
    split = F.floor(F.col("block") / split_blocks)
    splits = manifest.groupBy("path", "part", "file", split.alias("split")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("blocks"))
    placed = splits.join(file_starts(manifest), ["part", "file"])
    count = splits.count()
    spread = placed.repartition(max(1, -(-count // 4)), "path", "split").select("path", "at", "blocks", "first")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                out, held = [], 0
                with store.open_input_file(path) as source:
                    for key, place, ids in _File(source).documents(row["at"], row["blocks"]):
                        out.append((key, row["first"] + place, len(ids), ids.tobytes()))
                        held += 4 * len(ids) + 64
                        if held > 4 << 20:
                            yield _table(out, READ)
                            out, held = [], 0
                yield _table(out, READ)

    return spread.mapInArrow(scan, READ)


def token_folder(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
