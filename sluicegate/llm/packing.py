"""Best-fit packing of token sequences, planned on the histogram of their lengths."""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.bpe import ragged
from sluicegate.llm.ranks import number_within

CAPACITY = 4096
EOS = 1
#: Text whose distinct words are encoded together, held as numbers of words; a longer document is a group of its own.
GROUP_BYTES = 12 << 20
#: Text that is split into words, and later written as ids, at once; a longer document is a part of its own.
PART_BYTES = 1 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
# What the vocabulary file's own splitter takes as one piece, after lower-casing.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Characters of these texts are whole in composed form and have one lower-case form each.
PLAIN = re.compile(r"[!-~¡-¬®-±´¶-¸»¿-įĲ-ňŊ-ž]*")


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose splitter never joins across white space.

    Each distinct word of a group of texts is encoded once. Words of letters that need no composing are split here
    and given to the file's BPE model; all others go through the whole file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {bytes([b]).decode("latin-1"): c for b, c in _byte_letters().items()}

    def _word(self, word: str, known: dict[str, bytes]) -> bytes:
        if not PLAIN.fullmatch(word) or "<|" in word:
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        lower = word.lower()
        out = b""
        for piece in (lower,) if word.isalpha() else WORD.findall(lower):
            ids = known.get(piece)
            if ids is None:
                mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode().decode("latin-1")))
                ids = known[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            out += ids
        return out

    def encoded(self, parts: list[tuple[np.ndarray, pa.DictionaryArray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each part that :func:`split_words` gave: the ids of its texts, one after the other, and the number of each."""
        coded = pa.chunked_array([c for _, c in parts]).unify_dictionaries()
        words = coded.chunk(0).dictionary
        known: dict[str, bytes] = {}
        flat, ends = bytearray(), array("q", [0])
        for at in range(0, len(words), 10_000):
            for word in words.slice(at, 10_000).to_pylist():
                flat += self._word(word, known)
                ends.append(len(flat) // 4)
        del known, words
        ids, firsts = np.frombuffer(flat, dtype=np.uintc), np.frombuffer(ends, dtype=np.int64)
        sizes = np.diff(firsts)
        for (offsets, _), chunk in zip(parts, coded.chunks, strict=True):
            code = chunk.indices.to_numpy()
            lengths = sizes[code]
            own = ids[ragged(firsts[code], lengths)].astype("<u4", copy=False)
            yield own, np.diff(np.concatenate(([0], np.cumsum(lengths)))[offsets])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the number of each; none for null or empty texts."""
        return next(self.encoded([split_words(texts)]))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the words of each text begin and end among those of all texts, and these words as numbers."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    return split.offsets.to_numpy(), split.flatten().dictionary_encode()


def divided(batch: pa.RecordBatch, text: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose texts begin within ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = (np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(size)], strict=True):
        yield batch.slice(lo, hi - lo)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write each byte with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    A text's ids are followed by ``eos``. Sequences longer than ``capacity`` are cut into pieces of that
    length, the last may be shorter. Null and empty texts are the single id ``eos``; null and repeated
    doc_ids are carried as they are, row by row. Other columns of ``docs`` are ignored.
    """
    last = np.array([eos], dtype="<u4")

    def told(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    def encode(keys: list[list], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        for own, (ids, lengths) in zip(keys, word_tokenizer(vocabulary).encoded(parts), strict=True):
            ids, lengths = np.insert(ids, np.cumsum(lengths), last[0]), lengths + 1
            ends = np.cumsum(lengths)
            out: list[tuple] = []
            for key, begin, end in zip(own, (ends - lengths).tolist(), ends.tolist(), strict=True):
                for piece, at in enumerate(range(begin, end, capacity)):
                    cut_ids = ids[at : min(end, at + capacity)]
                    out.append((key, piece, at - begin, len(cut_ids), cut_ids.tobytes()))
                if len(out) > 500:
                    yield told(out)
                    out = []
            yield told(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for batch in batches:
            for part in divided(batch):
                keys.append(part.column("doc_id").to_pylist())
                parts.append(split_words(part.column("text")))
                held += part.column("text").nbytes
                if held >= GROUP_BYTES:
                    yield from encode(keys, parts)
                    keys, parts, held = [], [], 0
        if keys:
            yield from encode(keys, parts)

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(cut, PIECES)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, per sequence, offset).

    Longest lengths go first, each into the fullest sequences it fits into. Sequences with equal room are
    one class of consecutive numbers, so the work depends on the number of lengths, not of documents:
    a step either uses up a length or a class, and there are at most ``capacity`` of each.
    """
    rooms: list[int] = []  # sorted, of the classes below
    classes: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                insort(rooms, room)
                classes[room] = []
            classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                runs.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, n - full)
    return runs


def pack(sized: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of 1 to ``capacity`` tokens, in as few sequences as best fit finds.

    The histogram of lengths (at most ``capacity`` rows) is planned on the driver; rows take planned slots
    by joining on their rank within their length. The plan holds a few runs per length, so its broadcast
    is bounded by ``capacity``. All columns are kept; an empty table gives an empty one. Rows whose length
    is null, below 1 or above ``capacity`` are an error.
    """
    spark = sized.sparkSession
    carried = sized.select(F.col(length).cast("long").alias("own_length"), F.struct(*sized.columns).alias("given"))
    ranked = number_within(carried, "own_length", "length_rank")
    counts = {r[0]: r[1] for r in ranked.groupBy("own_length").count().collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths outside 1..{capacity}")
    runs: dict[int, list] = {}
    for n, rank, ranks, first, each, offset in plan_runs(counts, capacity):
        runs.setdefault(n, []).append((rank, rank + ranks, first, each, offset))
    # An Arrow table: rows of a list would start Python workers of their own, which stay for a minute.
    run = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64()), ("each", pa.int32()), ("offset", pa.int32())])
    listed = [[dict(zip(("low", "high", "first", "each", "offset"), r, strict=True)) for r in rs] for rs in runs.values()]
    plan = spark.createDataFrame(pa.table({"plan_length": pa.array(list(runs), pa.int32()), "runs": pa.array(listed, pa.list_(run))}))
    joined = ranked.join(F.broadcast(plan), F.col("own_length") == F.col("plan_length"))
    rank = F.col("length_rank")
    run = F.filter("runs", lambda r: (r["low"] <= rank) & (rank < r["high"]))[0]
    placed = joined.withColumn("run", run).withColumn("nth", rank - F.col("run.low"))
    return placed.select(
        *[F.col("given")[c].alias(c) for c in sized.columns],
        (F.col("run.first") + F.floor(F.col("nth") / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + F.col("nth") % F.col("run.each") * F.col("own_length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids. A group holds at most ``capacity`` tokens."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

