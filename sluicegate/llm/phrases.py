"""Substring dedup: recurring passages are found, confirmed and located by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.session import settle

WINDOW, ANCHOR = 20, 8
#: Text in one block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Windows of text for each bucket of hashes, at four bytes a word.
BUCKET_WINDOWS = 1_000_000
#: Phrases compiled into one automaton, which holds at most BASE * BASE different words.
SHARD_PHRASES, BASE = 50_000, 256
#: What stands for a word that no window of an automaton has.
OTHER = "\x01\x02"
KEPT_POWERS = 1 << 18
#: Of what moves between tasks, hashes aside, which do not shrink.
LEVEL = 6
NO_ID = (1 << 63) - 1
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCKS = "block bigint, doc_ids binary, known binary, sizes binary, texts binary, windows bigint"
HASHES = "bucket bigint, block bigint, hashes binary, again binary"
FIRSTS = "bucket bigint, block bigint, hashes binary, checks binary, docs binary, rows binary, starts binary, again binary"
PLACES = "block bigint, rows binary, starts binary, kept binary"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def to_blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as compressed blocks of a few MB, numbered by scan task: what moves later are these."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId() << 32, 0
        keys, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            ids = np.array([NO_ID if k is None else k for k in keys], dtype="<i8")
            known = np.array([k is not None for k in keys], dtype=np.uint8)
            sizes = np.array([len(t) for t in texts], dtype="<i8")
            n = sum(len(t) // 4 for t in texts)
            row = (part + block, ids.tobytes(), known.tobytes(), sizes.tobytes(), squeeze(b"".join(texts)), n)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = (value.as_py() or "").encode()
                keys.append(key.as_py())
                texts.append(raw)
                held += len(raw) + 64
                if held >= block_bytes:
                    yield done()
                    block, keys, texts, held = block + 1, [], [], 0
        if keys:
            yield done()

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(gather, BLOCKS)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def restore(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Block:
    """One block's documents, in the order of their doc_ids."""

    def __init__(self, row: dict):
        self.number = row["block"]
        ids = np.frombuffer(row["doc_ids"], "<i8")
        known = np.frombuffer(row["known"], np.uint8)
        sizes = np.frombuffer(row["sizes"], "<i8")
        joined = restore(row["texts"])
        ends = np.cumsum(sizes)
        order = np.argsort(ids, kind="stable")
        self.ids, self.known = ids[order], known[order]
        self.texts = [joined[ends[i] - sizes[i] : ends[i]] for i in order.tolist()]

    def windows(self, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
        """Of every window: its hash, a second hash, its anchor, the document's place in the block and its start."""
        parts = [(*_windows(t, window, anchor), i) for i, t in enumerate(self.texts) if len(t) >= 2 * window - 1]
        parts = [p for p in parts if len(p[0])]
        if not parts:
            none = np.zeros(0, dtype=np.uint64)
            return none, none.astype(np.uint32), none, none.astype(np.int64), none.astype(np.int64)
        starts = [np.arange(len(p[0])) for p in parts]
        docs = [np.full(len(p[0]), p[3]) for p in parts]
        return (*(np.concatenate([p[i] for p in parts]) for i in range(3)), np.concatenate(docs), np.concatenate(starts))


    def anchors(self, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors of the windows, and how often each run of words stands in the block."""
        least, runs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
        for text in self.texts:
            words = word_hashes(text)
            if len(words) >= window:
                own = _runs(words, anchor, P2)
                runs.append(own)
                least.append(np.unique(_least(own, window - anchor + 1)))
        seen, every = np.unique(np.concatenate(least)), np.sort(np.concatenate(runs))
        return seen, np.searchsorted(every, seen, "right") - np.searchsorted(every, seen, "left")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cumulative(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


@lru_cache(maxsize=4)
def _kept_powers(base: int) -> np.ndarray:
    return _cumulative(base, KEPT_POWERS)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ...; those of all but very long texts are computed once."""
    return _kept_powers(int(base))[:n] if n <= KEPT_POWERS else _cumulative(int(base), n)


@lru_cache(maxsize=4)
def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _runs(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of every ``length`` consecutive values."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    n = len(values) - length + 1
    return _mix((sums[length:] - sums[:n]) * _powers(_inverse(base), n))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word (a run of anything but ASCII white space)."""
    octets = np.frombuffer(raw, np.uint8)
    gap = np.concatenate(([True], SPACE[octets], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * _powers(P1, len(octets)), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_inverse(P1), len(octets) + 1)[starts] + (ends - starts).astype(np.uint64))


def _windows(raw: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = word_hashes(raw)
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.uint64)
        return none, none.astype(np.uint32), none
    first, second = _runs(words, window, P2), _runs(words, window, P1).astype(np.uint32)
    return first, second, _least(_runs(words, anchor, P2), window - anchor + 1)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values; equal windows have equal ones."""
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def _homes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(sorted_homes: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_homes)) + 1
    return [(int(sorted_homes[a]), a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_homes)], strict=True) if b > a]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def anchors(blocks: DataFrame, buckets: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The distinct anchors of every block by bucket, with a mark where one stands twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen, times = Block(row).anchors(window, anchor)
                homes = _homes(_mix(seen), buckets)  # least hashes are small ones: mixed, they spread evenly
                order = np.argsort(homes, kind="stable")
                seen, times, homes = seen[order], times[order], homes[order]
                yield _batch([(h, row["block"], seen[a:b].tobytes(), (times[a:b] > 1).tobytes()) for h, a, b in _slices(homes)], HASHES)

    return blocks.mapInArrow(find, HASHES)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one key after the other, from batches sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def recurring_anchors(found: DataFrame) -> DataFrame:
    """block, hashes: of each block's anchors those that recur, in it or in another block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "bucket"):
            each = [np.frombuffer(r["hashes"], "u8") for r in rows]
            again = np.concatenate([np.frombuffer(r["again"], bool) for r in rows])
            values, where, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            twice = times > 1
            twice[where[again]] = True
            mine = np.split(twice[where], np.cumsum([len(e) for e in each])[:-1])
            out = [(r["block"], e[m].tobytes()) for r, e, m in zip(rows, each, mine, strict=True) if m.any()]
            yield _batch(out, "block bigint, hashes binary")

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "block bigint, hashes binary")


def candidate_windows(blocks: DataFrame, recurring: DataFrame, buckets: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Windows whose anchor recurs, once per block at their first place in it, by bucket."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                hashes, checks, least, docs, starts = block.windows(window, anchor)
                anchors_here = np.sort(np.concatenate([np.frombuffer(h, "u8") for h in row["recurring"]]))
                at = np.minimum(np.searchsorted(anchors_here, least), len(anchors_here) - 1)
                some = np.flatnonzero(anchors_here[at] == least)
                hashes, checks, docs, starts = hashes[some], checks[some], docs[some], starts[some]
                order = np.lexsort((starts, block.ids[docs], checks, hashes))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
                firsts = order[new]
                size = np.diff(np.append(np.flatnonzero(new), len(order)))
                homes = _homes(hashes[firsts], buckets)
                out = []
                for home, a, b in _slices(homes):
                    own = firsts[a:b]
                    columns = (hashes[own], checks[own], block.ids[docs[own]], docs[own].astype("<u4"), starts[own].astype("<u4"), size[a:b] > 1)
                    out.append((home, row["block"], columns[0].tobytes(), columns[1].tobytes(), *(squeeze(c.tobytes()) for c in columns[2:])))
                yield _batch(out, FIRSTS)

    lists = recurring.groupBy("block").agg(F.collect_list("hashes").alias("recurring"))
    return blocks.join(lists, "block").mapInArrow(find, FIRSTS)


def confirm(candidates: DataFrame) -> DataFrame:
    """block, rows, starts, kept: the windows of each block that recur, and whether their first place is here.

    Windows are equal if 96 bits of two hashes are. A block has only its own first place of each window, so
    one window that is everywhere is one entry per block.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "bucket"):
            rows = [r | {c: restore(r[c]) for c in ("docs", "rows", "starts", "again")} for r in rows]
            hashes, checks, docs, places, starts, again = (
                np.concatenate([np.frombuffer(r[c], t) for r in rows])
                for c, t in (("hashes", "u8"), ("checks", "u4"), ("docs", "i8"), ("rows", "u4"), ("starts", "u4"), ("again", bool))
            )
            order = np.lexsort((starts, docs, checks, hashes))
            hashes, checks, docs, again = (x[order] for x in (hashes, checks, docs, again))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            size = np.diff(np.append(first, len(order)))
            recurs = ((size > 1) | (np.add.reduceat(again.astype(np.int64), first) > 0))[group]
            kept = (docs == docs[first][group]) & (starts[order] == starts[order][first][group])
            flags = np.zeros((2, len(order)), dtype=bool)
            flags[:, order] = recurs, kept
            out, at = [], 0
            for row in rows:  # back in the order they came in
                end = at + len(row["again"])
                own = at + np.flatnonzero(flags[0, at:end])
                if len(own):
                    out.append((row["block"], *(squeeze(c.tobytes()) for c in (places[own], starts[own], flags[1, own]))))
                at = end
            yield _batch(out, PLACES)

    return candidates.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(resolve, PLACES)


class Confirmed:
    """The recurring windows of one block, each at its first place in it, and phrases that find them.

    A window's phrase is its anchor: neighbouring windows share it, so there are far fewer phrases.
    """

    def __init__(self, block: Block, rows: list[dict], window: int, anchor: int):
        columns = [np.concatenate([np.frombuffer(restore(r[c]), t) for r in rows] or [np.zeros(0, t)]) for c, t in (("rows", "u4"), ("starts", "u4"), ("kept", bool))]
        order = np.lexsort((columns[1], columns[0]))
        doc, start, first = (c[order] for c in columns)
        doc, start = doc.astype(np.int64), start.astype(np.int64)
        hashes, self.phrases = [np.zeros(0, dtype=np.uint64)], []
        span = np.arange(window - anchor + 1)
        for i, a, b in _slices(doc):
            own = word_hashes(block.texts[i])
            hashes.append(_runs(own, window, P2)[start[a:b]])
            least = _runs(own, anchor, P2)[start[a:b, None] + span].argmin(axis=1)
            self.phrases += [(i, p) for p in np.unique(start[a:b] + least).tolist()]
        whole = np.concatenate(hashes)
        by_hash = np.argsort(whole, kind="stable")
        self.hashes, self.doc, self.start, self.first = whole[by_hash], doc[by_hash], start[by_hash], first[by_hash]


def compile_shards(words: list[list[bytes]], phrases: list[tuple[int, int]], anchor: int, shard: int) -> Iterator[tuple]:
    """Automata over numbered words, each of at most ``shard`` phrases.

    Words are numbered per automaton, so a match is a match of words, not of hashes. A number is two letters
    of two alphabets: nodes have few children, and matches begin and end at words.
    """
    number: dict[bytes, str] = {}
    automaton, held = ahocorasick.Automaton(), 0
    for doc, start in phrases:
        if held == shard or len(number) > BASE * BASE - anchor:
            automaton.make_automaton()
            yield number, automaton
            number, automaton, held = {}, ahocorasick.Automaton(), 0
        letters = ""
        for word in words[doc][start : start + anchor]:
            own = number.get(word)
            if own is None:
                high, low = divmod(len(number), BASE)
                own = number[word] = chr(0x100 + high) + chr(0x400 + low)
            letters += own
        automaton.add_word(letters, anchor)
        held += 1
    if held:
        automaton.make_automaton()
        yield number, automaton


class _Letters(dict):
    def __missing__(self, word: bytes) -> str:
        return OTHER


def _equal(words: list[list[bytes]], doc: int, at: np.ndarray, found: Confirmed, which: np.ndarray, window: int) -> np.ndarray:
    """Of windows with equal hashes the confirmed one with equal words, or -1. Neighbours are compared together."""
    out = which.copy()
    other, start = found.doc[which], found.start[which]
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(start) != 1) | (np.diff(other) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
        here, there, n = int(at[a]), int(start[a]), b - a + window - 1
        if words[doc][here : here + n] == words[other[a]][there : there + n]:
            continue
        for j in range(a, b):
            own, w = words[doc][at[j] : at[j] + window], int(which[j])
            h = found.hashes[w]
            while w < len(found.hashes) and found.hashes[w] == h and words[found.doc[w]][found.start[w] : found.start[w] + window] != own:
                w += 1
            out[j] = w if w < len(found.hashes) and found.hashes[w] == h else -1
    return out


def mark(block: Block, rows: list[dict], window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD_PHRASES) -> Iterator[tuple]:
    """Streams a block's documents through its automata: (doc_id, n_words, n_removed, kept) of each.

    Around every phrase that an automaton finds, the windows that can hold it are compared with the confirmed ones.
    """
    words = [t.split() for t in block.texts]
    found = Confirmed(block, rows, window, anchor)
    near = [[] for _ in words]
    for number, automaton in compile_shards(words, found.phrases, anchor, shard):
        letter = _Letters(number).__getitem__
        for i, own in enumerate(words):
            if len(own) >= window:
                near[i] += [end // 2 for end, _ in automaton.iter("".join(map(letter, own)))]
    for i, own in enumerate(words):
        left = own
        if near[i]:
            last = np.array(near[i])  # the phrase's last word
            n = len(own) - window + 1
            reach = np.zeros(n + 1, dtype=np.int64)
            np.add.at(reach, np.clip(last - window + 1, 0, n), 1)
            np.add.at(reach, np.clip(last - anchor + 2, 0, n), -1)
            at = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
            hashes = _runs(word_hashes(block.texts[i]), window, P2)[at]
            which = np.minimum(np.searchsorted(found.hashes, hashes), len(found.hashes) - 1)
            some = found.hashes[which] == hashes
            at, which = at[some], which[some]
            if len(at):
                which = _equal(words, i, at, found, which, window)
                at, which = at[which >= 0], which[which >= 0]
                first = found.first[which] & (found.start[which] == at) & (block.ids[found.doc[which]] == block.ids[i])
                delta = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(delta, at[~first], 1)
                np.add.at(delta, at[~first] + window, -1)
                left = [own[j] for j in np.flatnonzero(np.cumsum(delta[:-1]) == 0).tolist()]
        yield int(block.ids[i]) if block.known[i] else None, len(own), len(own) - len(left), b" ".join(left)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS, shard: int = SHARD_PHRASES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8 bytes of the kept words joined by spaces) of every row.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id,
    or before in the same document. Windows are judged on the input. Rows that repeat a doc_id stand at the
    same places, so none of them is earlier; a null doc_id is larger than any other. Null texts have no words.
    Other columns are ignored. ``docs`` should be a stored table: blocks are numbered by scan task.

    Equal windows have the same least anchor (a run of ``anchor`` words), so only windows whose anchor recurs
    are candidates. Those that recur are confirmed with the place where each stands first. Every block's
    documents are streamed through automata of the anchors of its confirmed windows, and what stands around
    a match is compared with the confirmed windows word by word.
    """
    blocks = settle(to_blocks(docs, doc_id, text, block_bytes))
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    buckets = max(1, -(-total // bucket_windows))
    found = recurring_anchors(anchors(blocks, buckets, window, anchor))
    places = confirm(candidate_windows(blocks, found, buckets, window, anchor))
    lists = places.groupBy("block").agg(F.collect_list(F.struct("rows", "starts", "kept")).alias("places"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, held = [], 0
                for made in mark(Block(row), row["places"] or [], window, anchor, shard):
                    out.append(made)
                    held += len(made[-1])
                    if held > 4 << 20:
                        yield _batch(out, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
                        out, held = [], 0
                yield _batch(out, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")

    return blocks.join(lists, "block", "left").mapInArrow(stream, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
