"""SimHash near-dedup: fingerprints, and exact Hamming neighbours by vantage-point shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.components import components
from sluicegate.session import settle

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints that one shard should hold on average; decides how many levels the tree has.
SHARD = 1000
LEAST_LEVELS, MOST_LEVELS = 3, 10
#: Vantage points are chosen on this many fingerprints, the smallest by hash.
SAMPLE, CANDIDATES = 4096, 32
CELL = BITS + 1
PAIRS = 1 << 21
#: Members of a cell that one task compares with each other; a cell with more is split into blocks.
MOST_MEMBERS = 16_384
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned; zero if it has no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row. Null and empty texts have fingerprint zero.

    Words are runs of anything but ASCII white space, A-Z in lower case. Texts of fewer words than a shingle
    are one shingle. Null and repeated doc_ids are carried row by row; other columns are ignored.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype="u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view("i8"))], ["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(hashed, "doc_id bigint, fp bigint")


def levels_for(n: int, shard: int = SHARD) -> int:
    """Fewest levels at which ``n`` evenly spread fingerprints leave about ``shard`` in a shard.

    Distances over b of the bits spread over about 2.07 * sqrt(b) values.
    """
    for m in range(LEAST_LEVELS, MOST_LEVELS):
        if n <= shard * (2.07 * sqrt(BITS / m)) ** m:
            return m
    return MOST_LEVELS


def choose_vantage_points(sample: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """(mask, vantage point) per level: disjoint bit groups, and the sampled point that spreads distances most."""
    edges = [BITS * i // levels for i in range(levels + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = []
    for mask in masks:
        best = None
        for point in sample[:CANDIDATES] if len(sample) else np.zeros(1, dtype="u8"):
            spread = np.bincount(np.bitwise_count((sample ^ point) & np.uint64(mask)), minlength=CELL)
            shared = int((spread.astype(np.int64) ** 2).sum())
            if best is None or shared < best[0]:
                best = (shared, int(point))
        chosen.append((mask, best[1]))
    return chosen


def offsets(levels: int, radius: int = RADIUS) -> np.ndarray:
    """The shards around a home shard that can hold a neighbour, one of each opposite pair, home first.

    A fingerprint within ``radius`` differs by at most that much in its distance to each vantage point
    (triangle inequality). The levels measure disjoint bits, so the differences add up to at most ``radius``.
    """
    around = [o for o in product(range(-radius, radius + 1), repeat=levels) if 0 < sum(map(abs, o)) <= radius]
    forward = [o for o in around if next(x for x in o if x) > 0]
    return np.array([(0,) * levels, *sorted(forward)], dtype=np.int64)


def to_shards(prints: DataFrame, points: list[tuple[int, int]], radius: int = RADIUS, blocks: dict[int, int] | None = None, deal: str = "fp") -> DataFrame:
    """cell, block, asks and the columns of ``prints``: every row once as a member of its home shard, and as a query to those it overlaps.

    A cell that ``blocks`` names is that many shards: its members are dealt by a hash of ``deal``, go as
    queries to the later blocks of their cell, and queries from elsewhere go to each block.
    """
    around = offsets(len(points), radius)
    scale = np.array([CELL**i for i in range(len(points))], dtype=np.int64)
    widths = np.array([mask.bit_count() for mask, _ in points], dtype=np.int64)
    split = np.array(sorted((blocks or {}).items()), dtype=np.int64).reshape(-1, 2)

    def parts_of(cell: np.ndarray) -> np.ndarray:
        if not len(split):
            return np.ones(len(cell), dtype=np.int64)
        at = np.minimum(np.searchsorted(split[:, 0], cell), len(split) - 1)
        return np.where(split[at, 0] == cell, split[at, 1], 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, dealt = (batch.column(c).to_numpy(zero_copy_only=False).view("u8") for c in ("fp", deal))
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                home = np.stack([np.bitwise_count((fp ^ np.uint64(p)) & np.uint64(m)).astype(np.int64) for m, p in points], axis=1)
                targets = home[:, None, :] + around[None, :, :]
                inside = ((targets >= 0) & (targets <= widths)).all(axis=2)
                row, which = np.nonzero(inside)
                cell = (targets[row, which] * scale).sum(axis=1)
                parts = parts_of(cell)
                row, which, cell = (np.repeat(x, parts) for x in (row, which, cell))
                block = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = ((dealt[at : at + 4096][row] * SPREAD) >> np.uint64(32)).astype(np.int64) % np.repeat(parts, parts)
                sent = (which > 0) | (block >= own)
                asks = (which > 0) | (block > own)
                carried = batch.slice(at, len(fp)).take(pa.array(row[sent]))
                marks = [pa.array(cell[sent]), pa.array(block[sent]), pa.array(asks[sent])]
                yield pa.RecordBatch.from_arrays([*marks, *carried.columns], ["cell", "block", "asks", *carried.schema.names])

    carried = ", ".join(f"{c} {kind}" for c, kind in prints.dtypes)
    return prints.mapInArrow(route, f"cell bigint, block bigint, asks boolean, {carried}")


def vantage_points(prints: DataFrame, levels: int) -> list[tuple[int, int]]:
    """Vantage points for the fingerprints in column fp, chosen on the first of them by hash."""
    sample = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    return choose_vantage_points(np.array([r["fp"] for r in sample], dtype="i8").view("u8"), levels)


def overfull(prints: DataFrame, points: list[tuple[int, int]], most: int = MOST_MEMBERS) -> dict[int, int]:
    """The cells with more than ``most`` members, and into how many blocks each is split."""
    members = to_shards(prints, points, 0).groupBy("cell").count().where(F.col("count") > most)
    return {r["cell"]: -(-r["count"] // most) for r in members.collect()}


def _grow(members: np.ndarray, radius: int) -> np.ndarray:
    """For each member the index of the first member of its component within the shard."""
    n = len(members)
    label = np.arange(n)
    step = max(1, PAIRS // max(n, 1))
    lonely = np.ones(n, dtype=bool)
    for at in range(0, n, step):
        near = np.bitwise_count(members[at : at + step, None] ^ members[None, :]) <= radius
        lonely[at : at + step] = near.sum(axis=1) <= 1
    open_ = np.flatnonzero(~lonely)
    while len(open_):
        root, frontier, open_ = open_[0], open_[:1], open_[1:]
        while len(frontier) and len(open_):
            reached = np.zeros(len(open_), dtype=bool)
            step = max(1, PAIRS // len(open_))
            for at in range(0, len(frontier), step):
                near = np.bitwise_count(members[frontier[at : at + step], None] ^ members[open_][None, :]) <= radius
                reached |= near.any(axis=0)
            frontier, open_ = open_[reached], open_[~reached]
            label[frontier] = root
    return label


class _Shard:
    """The members of one shard, then queries against them; gives links that connect all that is near."""

    def __init__(self, radius: int):
        self.radius, self.cell, self.held, self.members, self.label = radius, None, [], None, None

    def add(self, cell: tuple[int, int], asks: bool, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if cell != self.cell:
            yield from self.close()
            self.cell = cell
        if not asks:
            self.held.append(fp)
            return
        yield from self.close()
        if len(self.members):
            step = max(1, PAIRS // len(self.members))
            for at in range(0, len(fp), step):
                part = fp[at : at + step]
                near = np.bitwise_count(part[:, None] ^ self.members[None, :]) <= self.radius
                row, col = np.nonzero(near)
                if len(row):
                    pair = np.unique(row * len(self.members) + self.label[col])
                    yield part[pair // len(self.members)], self.members[pair % len(self.members)]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All members of the current shard are here."""
        if self.held or self.members is None:
            self.members = np.concatenate(self.held) if self.held else np.zeros(0, dtype="u8")
            self.held = []
            self.label = _grow(self.members, self.radius)
            moved = self.label != np.arange(len(self.members))
            if moved.any():
                yield self.members[moved], self.members[self.label[moved]]


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST_MEMBERS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect exactly those within ``radius``.

    Every pair within the radius meets in one shard: the tree of vantage points sends each fingerprint to
    its home shard, and to the shards that its ball overlaps. A shard holds its members (8 bytes each) and
    streams the queries in blocks. Within a shard a component is given as a tree, and a query is linked
    once to each component of members it is near, so dense groups do not turn into all their pairs. A cell
    of more than ``most`` members is split into blocks that are shards of their own and meet as queries.
    """
    points = vantage_points(prints, levels_for(prints.count()))
    blocks = overfull(prints, points, most)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(radius)

        def told(pairs):
            for a, b in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], ["a", "b"])

        for batch in batches:
            cell, block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "asks"))
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if hi > lo:
                    yield from told(shard.add((int(cell[lo]), int(block[lo])), bool(asks[lo]), fp[lo:hi]))
        yield from told(shard.close())

    dealt = to_shards(prints, points, radius, blocks).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Documents are linked when their fingerprints differ in at most ``radius`` bits. Documents with one
    fingerprint are one node, whatever their number. component_id is null only where all doc_ids of a
    component are. An empty table gives an empty one.
    """
    prints = settle(fingerprints(docs, doc_id, text))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    hung = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(hung, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their near-duplicate component, all columns kept.

    A doc_id names a document: rows that repeat one go or stay together, and rows without one stay.
    Documents meet only the list of doc_ids to drop.
    """
    groups = near_groups(docs, doc_id, text, radius)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_doc_id")).distinct()
    return docs.join(dropped, docs[doc_id].cast("bigint") == F.col("dropped_doc_id"), "left_anti")
