"""Near copies of texts: SimHash neighbours whose five-word shingles are alike, found by min-hash sketches in their shard.

What fingerprints, estimates and the one link a component leave out is found exactly, by rare shingles (:func:`missed`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.llm import simhash
from sluicegate.llm.components import components
from sluicegate.session import settle

SHINGLE, LEAST = 5, 0.8
#: Bits by which fingerprints of near copies may differ. One edit breaks fewer 3-word shingles than 5-word ones, so the
#: 3-word fingerprints of texts at 0.8 lie about 8 to 10 bits apart.
RADIUS = 13
#: Bins of a sketch; each keeps a byte of its least shingle hash. The estimate's standard error is 0.025 for long texts
#: and less for short ones, whose shingles have bins of their own.
BINS = 256
#: The estimate from which texts are compared: two standard errors below ``LEAST``.
ESTIMATE = 0.75
#: Members of a shard that meet in one task; a cell with more is dealt to several. Rows are sent once per part, so a cell of
#: more than PARTS such shards gets larger ones instead, of at most MOST_MEMBERS (18 MB).
MOST, PARTS, MOST_MEMBERS = 4096, 8, 65_536
PAIRS = 1 << 21
KIND = np.dtype([("id", "<i8"), ("fp", "<u8"), ("size", "<i8"), ("sketch", "u1", (BINS,))])
ROUTED = "cell int, block int, peer int, asks boolean, id bigint, fp bigint, size bigint, sketch binary"
#: Neighbouring cells that a node asks, one of each opposite pair: bands of sizes by rings around the vantage point.
AROUND = ((0, 1), (1, -1), (1, 0), (1, 1))
RINGS = simhash.BITS // RADIUS + 3
#: A head has one hash more for each so many hashes of its set than it takes to share one with every near copy.
SPARE = 10
#: Shingles of one block of the exact comparison; candidates that have more are dealt to several.
LOAD = 1 << 19


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's five-word shingles, ascending; words are those of the fingerprints."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) > SHINGLE else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(simhash.SEED)), dtype="<u8"))


def head(hashes: np.ndarray) -> np.ndarray:
    """The least hashes of a set, so many that it shares at least :func:`_in_heads` with the head of every near copy.

    Sets of n and m <= n hashes at ``LEAST`` share ceil(LEAST * n) or more. The t-th least of the shared ones comes after
    at most n - ceil(LEAST * n) others in either set, so it is in both heads for t up to m // SPARE + 1.
    """
    n = len(hashes)
    return hashes[: n - int(np.ceil(LEAST * n - 1e-9)) + n // SPARE + 1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte per bin, of the least hash in it; 0 where the bin is empty. ``hashes`` ascend."""
    out = np.zeros(BINS, dtype=np.uint8)
    # Written from the largest on, so that the least hash of a bin is written last.
    down = hashes[::-1]
    out[(down % np.uint64(BINS)).astype(np.int64)] = (1 + (down // np.uint64(BINS)) % np.uint64(255)).astype(np.uint8)
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities estimated from rows of sketches: the share of equal bins among those not empty in both."""
    used = ((a | b) != 0).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    return (equal / np.maximum(used, 1) - 1 / 255) * (255 / 254)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    """Hashes as lists of signed longs."""
    ends = np.cumsum([0, *map(len, sets)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u8"), *sets]).view("i8")))


def described(body: DataFrame) -> DataFrame:
    """doc_id, at (digest of the text), class (digest of the set of shingles), fp, size, sketch and head, of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            fp = np.array([simhash.fingerprint(t) for t in texts], dtype="u8").view("i8")
            names = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int64())
            drawn = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
            columns = [batch.column("doc_id"), batch.column("at"), names, pa.array(fp), size, drawn, _lists([head(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "class", "fp", "size", "sketch", "head"])

    return body.mapInArrow(measure, "doc_id long, at string, class binary, fp long, size long, sketch binary, head array<long>")


def _cells(fp: np.ndarray, size: np.ndarray, point: int) -> tuple[np.ndarray, np.ndarray]:
    """The band and the ring of nodes.

    Sizes of near copies differ by a factor of 1 / LEAST at most, and distances to the vantage point by RADIUS at most
    (triangle inequality); so both numbers differ by one at most.
    """
    band = np.floor(np.log(np.maximum(size, 1)) / (-np.log(LEAST) + 1e-9)).astype(np.int64)
    ring = np.bitwise_count(fp ^ np.uint64(point)).astype(np.int64) // RADIUS + 1
    return band, ring


def cell_parts(nodes: DataFrame, point: int, most: int = MOST) -> dict[int, int]:
    """Into how many parts each cell is dealt. There are a few hundred cells, whatever the number of nodes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, ring = _cells(batch.column("fp").to_numpy().view("u8"), batch.column("size").to_numpy(), point)
            cells, n = np.unique(band * RINGS + ring, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    counted = nodes.select("fp", "size").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = {r["cell"]: r["n"] for r in counted.collect()}
    steps = [db * RINGS + dr for db, dr in AROUND]
    asked = {cell: sum(counts.get(cell - step, 0) for step in steps) for cell in counts}

    def dealt(n: int) -> int:
        return -(-n // max(most, min(MOST_MEMBERS, -(-n // PARTS))))

    return {cell: max(dealt(n), dealt(-(-asked[cell] // 4))) for cell, n in counts.items()}


def routed(nodes: DataFrame, point: int, parts: dict[int, int]) -> DataFrame:
    """Every node as a member of its cell and as a query to the cells around it, dealt to groups of bounded size.

    A cell of k parts has groups (block, peer) with block <= peer < k: the members of ``block`` meet the members of
    ``peer`` as queries, and a share of the queries from other cells. Cells without members are left out.
    """
    known = np.array(sorted(parts.items()), dtype=np.int64).reshape(-1, 2)

    def parts_of(cell: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(cell), dtype=np.int64)
        at = np.minimum(np.searchsorted(known[:, 0], cell), len(known) - 1)
        return np.where(known[at, 0] == cell, known[at, 1], 0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view("u8")
            band, ring = _cells(fp, batch.column("size").to_numpy(), point)
            draw = ((batch.column("id").to_numpy().view("u8") * simhash.SPREAD) >> np.uint64(33)).astype(np.int64)
            rows, cells, blocks, peers, asks = [], [], [], [], []
            for db, dr in ((0, 0), *AROUND):
                cell = (band + db) * RINGS + ring + dr
                k = parts_of(cell)
                row = np.repeat(np.arange(len(k)), k)
                i = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                k, drawn = k[row], draw[row]
                if (db, dr) == (0, 0):
                    own = drawn % k
                    # As a member of its block in the groups from there on, as a query in those of earlier blocks.
                    block, peer, asking = np.minimum(i, own), np.maximum(i, own), i < own
                else:
                    block, peer, asking = i, i + drawn % (k - i), np.ones(len(i), dtype=bool)
                for held, some in zip((rows, cells, blocks, peers, asks), (row, cell[row], block, peer, asking), strict=True):
                    held.append(some)
            row, cell, block, peer, asking = (np.concatenate(x) for x in (rows, cells, blocks, peers, asks))
            marks = [pa.array(x.astype(np.int32)) for x in (cell, block, peer)]
            carried = [batch.column(c).take(pa.array(row)) for c in ("id", "fp", "size", "sketch")]
            yield pa.RecordBatch.from_arrays([*marks, pa.array(asking), *carried], [c.split()[0] for c in ROUTED.split(", ")])

    return nodes.select("id", "fp", "size", "sketch").mapInArrow(route, ROUTED)


class _Group:
    """The members of one group, then queries against them; gives links that connect all that is near."""

    def __init__(self):
        self.members, self.label, self.held = np.zeros(0, dtype=KIND), np.zeros(0, dtype=np.int64), []
        self.fp = np.zeros(0, dtype=np.uint64)

    def _near(self, nodes: np.ndarray, after: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The place among ``nodes`` of each that is near members, and their places. ``after``: nodes are the members
        from there on, and meet later ones only."""
        row, col = np.nonzero(np.bitwise_count(nodes["fp"][:, None] ^ self.fp[None, :]) <= RADIUS)
        if after is not None:
            later = col > row + after
            row, col = row[later], col[later]
        one, two = nodes["size"][row], self.members["size"][col]
        fits = np.minimum(one, two) >= LEAST * np.maximum(one, two) - 1e-9
        row, col = row[fits], col[fits]
        cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(row)], strict=True):
            if hi > lo:
                yield int(row[lo]), col[lo:hi]

    def _met(self, node: np.void, some: np.ndarray) -> list[int]:
        """Of each component among ``some`` that holds a member alike to ``node``, the likest member."""
        if not len(some):
            return []
        told = estimates(self.members["sketch"][some], node["sketch"])
        alike = told >= ESTIMATE
        order = np.argsort(-told[alike], kind="stable")
        some = some[alike][order]
        return some[np.unique(self.label[some], return_index=True)[1]].tolist()

    def grow(self) -> list[tuple[int, int]]:
        """All members are here. Links that make a tree of each component."""
        self.members = np.concatenate(self.held) if self.held else self.members
        self.held = []
        self.label = np.arange(len(self.members))
        self.fp = np.ascontiguousarray(self.members["fp"])
        tree = []
        step = max(1, PAIRS // max(1, len(self.fp)))
        for at in range(0, len(self.fp), step):
            for nth, some in self._near(self.members[at : at + step], at):
                i = at + nth
                for place in self._met(self.members[i], some[self.label[some] != self.label[i]]):
                    self.label[self.label == self.label[place]] = self.label[i]
                    tree.append((int(self.members["id"][i]), int(self.members["id"][place])))
        return tree

    def ask(self, queries: np.ndarray) -> Iterator[tuple[int, int]]:
        """One link to each component that a query is near."""
        step = max(1, PAIRS // max(1, len(self.fp)))
        for at in range(0, len(queries) if len(self.fp) else 0, step):
            part = queries[at : at + step]
            for i, some in self._near(part):
                for place in self._met(part[i], some):
                    yield int(part["id"][i]), int(self.members["id"][place])


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: links between nodes (id, fp, size, sketch) that connect exactly those judged alike by their sketches.

    Two nodes are alike when their fingerprints differ in at most ``RADIUS`` bits, their sizes allow a similarity of
    ``LEAST``, and their sketches estimate ``ESTIMATE`` or more. Every such pair meets in one group. A component of
    members is given as a tree and a query is linked once to each component it is near, so that a dense group gives
    about one link a node, and a group of nodes that are near but not alike gives none. Of a component the likest
    member is linked.
    """
    point = simhash.vantage_points(nodes, 1)[0][1]
    dealt = routed(nodes, point, cell_parts(nodes, point, most))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, open_ = None, _Group(), True
        out: list[tuple[int, int]] = []

        def grown() -> list[tuple[int, int]]:
            # The groups of one block have the same members: one of them tells their tree.
            tree = group.grow()
            return tree if key[1] == key[2] else []

        def told() -> pa.RecordBatch:
            nonlocal out
            a, b = zip(*out, strict=True) if out else ((), ())
            out = []
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "block", "peer", "asks")], axis=1)
            rows = np.empty(len(marks), dtype=KIND)
            for name in ("id", "fp", "size"):
                rows[name] = batch.column(name).to_numpy().view(KIND[name])
            rows["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if hi == lo:
                    continue
                own = tuple(marks[lo, :3].tolist())
                if own != key:
                    if key is not None and open_:
                        out += grown()
                    key, group, open_ = own, _Group(), True
                if not marks[lo, 3]:
                    group.held.append(rows[lo:hi])
                    continue
                if open_:
                    out += grown()
                    open_ = False
                out += group.ask(rows[lo:hi])
            yield told()
        if key is not None and open_:
            out += grown()
        yield told()

    keys = ("cell", "block", "peer")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(compare, "a bigint, b bigint")


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``least``; two empty sets are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - shared
    return shared >= least * whole - 1e-9


def _least(size: str = "size") -> Column:
    """The fewest shingles that a set shares with a near copy."""
    return F.ceil(F.col(size) * LEAST - 1e-9)


def _in_heads(size: str = "size") -> Column:
    """The fewest hashes that a head shares with the head of a near copy."""
    return F.floor(_least(size) / SPARE) + 1


def _told_apart(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose hash stands under two or more values of ``by``, and df, the number of rows that have it."""
    of_hash = Window.partitionBy("hash")
    ends = [F.min(by).over(of_hash).alias("_lo"), F.max(by).over(of_hash).alias("_hi")]
    seen = rows.select("*", *ends, F.count(F.lit(1)).over(of_hash).alias("df"))
    return seen.where("_lo <> _hi").drop("_lo", "_hi")


def _enough(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with so many rows of head hashes in ``shared`` that they can have a near copy."""
    counts = shared.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return nodes.join(counts, "id").where(F.col("_n") >= _in_heads()).drop("_n")


def sets_of(asked: DataFrame, body: DataFrame) -> DataFrame:
    """id, size and hashes (all shingles) of the nodes (id, at) in ``asked``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, _lists(sets)], ["id", "size", "hashes"])

    texts = body.select("at", "text").join(asked.select("id", "at"), "at").groupBy("id").agg(F.first("text").alias("text"))
    return texts.mapInArrow(measure, "id long, size long, hashes array<long>")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach ``LEAST``. Sets move only for nodes that are in a pair, about one pair a node."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(f"hashes_{s}") for s in "ab")
            same = pa.array([similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(same) for c in batch.columns[:2]], ["a", "b"])

    sides = [sets.select(F.col("id").alias(s), F.col("hashes").alias(f"hashes_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(judge, "a bigint, b bigint")


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """a, b: links that make a tree of the roots whose nodes are alike, by exact overlaps of all pairs of a group.

    ``tokens`` are the hashes that other roots hold too. The nodes of two blocks meet across only.
    """
    lengths = group["tokens"].map(len).to_numpy()
    code = np.unique(np.concatenate(group["tokens"].to_list()), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(group)), lengths)
    holders = owner[np.argsort(code, kind="stable")]
    held = np.bincount(code)
    first, ends = np.cumsum(held) - held, np.cumsum(lengths)
    size, own, root = (group[c].to_numpy() for c in ("size", "own", "root"))
    across = group["block"].iat[0] != group["peer"].iat[0]
    label, tree = root.copy(), []
    for i in range(len(group)):
        mine = code[ends[i] - lengths[i] : ends[i]]
        n = held[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        overlap = np.bincount(holders[at], minlength=len(group))
        near = (overlap >= LEAST * (size[i] + size - overlap) - 1e-9) & (label != label[i]) & (np.arange(len(group)) > i)
        for j in np.flatnonzero(near & (own != own[i]) if across else near):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                tree.append((root[i], root[j]))
    return pd.DataFrame(tree, columns=["a", "b"], dtype="int64")


def missed(sets: DataFrame, shared: DataFrame, roots: DataFrame, load: int = LOAD) -> DataFrame:
    """a, b: links between roots that connect exactly those with nodes at ``LEAST`` or more.

    ``sets`` holds id, size and hashes of all nodes that can have a near copy, ``shared`` id and hash of head hashes that
    two nodes or more hold, ``roots`` node and root of what is linked already. A near copy under another root shares
    with a node ceil(LEAST * size) hashes that stand under several roots, and one of the rarest of them (a prefix
    filter). Roots that share such a hash are one group, however connected; a group is compared by exact overlaps, dealt
    to blocks of about ``load`` shingles that meet pairwise. No pair is left out, and a group gives a tree.
    """
    hung = roots.select(F.col("node").alias("id"), "root")
    sized = sets.select("id", "size").join(hung, "id", "left").withColumn("root", F.coalesce("root", "id"))
    able = _enough(_told_apart(shared.join(sized.select("id", "root"), "id"), "root"), sized)
    hashes = able.join(sets.select("id", "hashes"), "id").select("id", "root", "size", F.explode("hashes").alias("hash"))
    foreign = _told_apart(hashes, "root").groupBy("id", "root", "size")
    listed = foreign.agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("tokens"))
    nodes = settle(listed.where(F.size("tokens") >= _least()).withColumn("tokens", F.col("tokens.hash")))
    rare = nodes.select("root", F.explode(F.slice("tokens", F.lit(1), (F.size("tokens") - _least() + 1).cast("int"))).alias("hash")).distinct()
    stars = rare.select("root", F.min("root").over(Window.partitionBy("hash")).alias("least")).where("root <> least")
    group_of = components(stars).select(F.col("node").alias("root"), F.col("root").alias("cell"))
    dealt = settle(nodes.join(group_of, "root"))
    parts = dealt.groupBy("cell").agg(F.ceil(F.sum(F.size("tokens")) / load).alias("k"))
    spread = dealt.join(parts, "cell").withColumn("own", F.pmod(F.xxhash64("id"), "k"))
    spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    spread = spread.select("cell", F.least("own", "i").alias("block"), F.greatest("own", "i").alias("peer"), "own", "root", "size", "tokens")
    return spread.groupBy("cell", "block", "peer").applyInPandas(_joined, "a bigint, b bigint")


def _rooted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, at (digest of the text) and component_id of every row."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), value.alias("text")).withColumn("at", F.md5("text"))
    rows = settle(described(body))
    one = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("at", "fp", "size", "sketch", "head")).alias("one"))
    # Stored, so that the numbers stay.
    nodes = settle(one.select(F.monotonically_increasing_id().alias("id"), "class", "least", "one.*"))
    shared = settle(_told_apart(nodes.select("id", F.explode("head").alias("hash")), "id").select("id", "hash"))
    # Only texts whose heads allow a near copy are dealt to shards: rows are sent there once per part of a cell.
    able = settle(_enough(shared, nodes.select("id", "at", "fp", "size", "sketch")))
    found = settle(links(able).distinct())
    sets = settle(sets_of(able, body))
    hung = components(checked(found, sets))
    more = components(missed(sets, shared, hung)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = nodes.select("id", "class", "least").join(hung.withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "id")).join(more, "root", "left").withColumn("root", F.coalesce("top", "root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(lowest, "root").select("class", "component_id")
    return rows.select("doc_id", "at", "class").join(of_class, "class").select("doc_id", "at", "component_id")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) of every row.

    Rows with one set of five-word shingles are one class, whatever their number. Classes are linked as :func:`links`
    says, and the texts at both ends of a link must reach ``LEAST``; so no row is in a component by estimate alone. Texts of fewer words than a shingle are one shingle, null and empty ones have none and are one class.
    component_id is null only where all doc_ids of a component are. Other columns are ignored.
    """
    return _rooted(docs, doc_id, text).select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their near-copy component, all columns kept.

    A row is named by doc_id and text: rows that repeat a doc_id with another text are judged by that text, equal rows
    stay or go together, and rows without a doc_id stay.
    """
    dropped = _rooted(docs, doc_id, text).where("doc_id <> component_id").select("doc_id", "at").distinct()
    at = F.md5(F.coalesce(docs[text].cast("string"), F.lit("")))
    return docs.join(dropped, (docs[doc_id].cast("bigint") == dropped["doc_id"]) & (at == dropped["at"]), "left_anti")
