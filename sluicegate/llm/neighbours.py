"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.session import settle

#: Dimensions of the projections (even: the distribution then has a closed form) and vectors in a leaf of a tree.
PROJECTED, LEAF = 8, 32
#: The chance that a true neighbour is found before the test stops a search.
CONFIDENCE = 0.98
#: Distinct vectors in one tree, queries that go through it together.
TREE_VECTORS, QUERY_VECTORS = 8192, 4096
SEED = 11
PACKED = "dims int, block int, ids binary, sizes binary, vectors binary"


def chi_square_below(x: np.ndarray, freedom: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term = x / 2, np.ones_like(x)
    total = np.ones_like(x)
    for i in range(1, freedom // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def chi_square_cut(confidence: float, freedom: int) -> float:
    """Where the distribution function reaches ``confidence``."""
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(np.array(middle), freedom) < confidence else (low, middle)
    return high


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and vector (doubles) of rows that take part: no null, zero or non-finite vector."""
    typed = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return typed.where(F.col("vector").isNotNull() & ~bad & some)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """dims, home (a hash), vector and ids: of equal vectors the k + 1 smallest ids.

    More can never be among the k nearest of a query, own row left out, as ties go to smaller ids. Each task
    keeps no more than that of a vector before anything moves.
    """
    hashed = rows.withColumn("home", F.xxhash64("vector"))
    ranked = hashed.withColumn("place", F.row_number().over(Window.partitionBy("home", "vector").orderBy(F.col("id").asc_nulls_last())))
    few = ranked.where(F.col("place") <= k + 1)
    grouped = few.groupBy("home", "vector").agg(F.array_sort(F.collect_list(F.coalesce("id", F.lit((1 << 63) - 1)))).alias("ids"))
    return grouped.withColumn("dims", F.size("vector"))


def packed(rows: DataFrame, per_block: int, blocks: int) -> DataFrame:
    """Blocks of vectors as packed arrays, by dims and hash; each block is one task's group of bounded size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            ids = [i for r in held for i in r["ids"]]
            out = (key[0], key[1], np.array(ids, "<i8").tobytes(), np.array([len(r["ids"]) for r in held], "<i4").tobytes(), np.array([r["vector"] for r in held], "<f8").tobytes())
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["dims"], row["block"])
                if held and (own != key or len(held) >= 2 * per_block):
                    yield done()
                    held = []
                key = own
                held.append(row)
        if held:
            yield done()

    dealt = rows.select("dims", F.pmod("home", F.lit(blocks)).cast("int").alias("block"), "ids", "vector")
    return dealt.repartition("dims", "block").sortWithinPartitions("dims", "block").mapInArrow(pack, PACKED)


class Tree:
    """A kd-tree over projected vectors: leaves with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        self._split(points, np.arange(len(points)), leaf)
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def _split(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        if len(rows) <= leaf:
            self.leaves.append(rows)
            return
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, axis], len(rows) // 2)
        self._split(points, rows[order[: len(rows) // 2]], leaf)
        self._split(points, rows[order[len(rows) // 2 :]], leaf)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of projected queries to the leaves' boxes."""
        out = np.zeros((len(queries), len(self.leaves)))
        for axis in range(queries.shape[1]):
            q = queries[:, axis, None]
            gap = np.maximum(np.maximum(self.low[None, :, axis] - q, q - self.high[None, :, axis]), 0)
            out += gap * gap
        return out


def search(vectors: np.ndarray, queries: np.ndarray, k: int, largest: float, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """For each query the indices and inner products of the ``k`` nearest vectors found (-1 where fewer).

    A vector with norm n gets the coordinate sqrt(largest - n * n), a query zero, so that the largest inner
    product is the smallest distance. Both are projected on PROJECTED Gaussian directions. Leaves are
    verified in the order of their projected distance r; a search stops when a vector as near as the k-th
    found would lie within r with probability ``confidence``, which is a chi-square test of (r / d) ** 2.
    """
    dims = vectors.shape[1]
    directions = np.random.default_rng((SEED, dims)).normal(size=(dims + 1, PROJECTED))
    rest = np.sqrt(np.maximum(largest - (vectors * vectors).sum(axis=1), 0))
    tree = Tree(vectors @ directions[:-1] + rest[:, None] * directions[-1])
    bounds = tree.bounds(queries @ directions[:-1])
    order = np.argsort(bounds, axis=1)
    far = (queries * queries).sum(axis=1) + largest
    cut = chi_square_cut(confidence, PROJECTED)
    n = len(queries)
    best = np.full((n, k), -np.inf)
    which = np.full((n, k), -1, dtype=np.int64)
    active, done, step = np.arange(n), 0, 2
    while len(active) and done < len(tree.leaves):
        part = order[active, done : done + step]
        leaf_of = part.ravel()
        row_of = np.repeat(active, part.shape[1])
        by_leaf = np.argsort(leaf_of, kind="stable")
        for some in np.split(by_leaf, np.flatnonzero(np.diff(leaf_of[by_leaf])) + 1):
            rows, own = row_of[some], tree.leaves[leaf_of[some[0]]]
            # einsum adds up each pair in one order, so equal vectors have equal products.
            found = np.concatenate([best[rows], np.einsum("qd,xd->qx", queries[rows], vectors[own])], axis=1)
            names = np.concatenate([which[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
            top = np.argpartition(-found, k - 1, axis=1)[:, :k]
            best[rows] = np.take_along_axis(found, top, axis=1)
            which[rows] = np.take_along_axis(names, top, axis=1)
        done += step
        step *= 2
        if done < len(tree.leaves):
            kth = np.maximum(far[active] - 2 * best[active].min(axis=1), 0)
            reach = bounds[active, order[active, done]]
            active = active[~(reach > cut * kth)]
    return which, best


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows found with the largest inner products per query.

    Scores are inner products in double precision; ties go to the smaller id. Rows with the query's own id are
    left out. Vectors that are null, zero or hold null or non-finite components take no part; vectors meet
    only those of their own length. Ids that are null take no part either; a repeated query row is one query.
    Every query block meets every tree; a query's best of each tree are merged. An empty side gives no rows.
    """
    candidates = settle(distinct_vectors(usable(rows, vec_id, vector).where("id IS NOT NULL"), k))
    asked = usable(queries, vec_id, vector).where("id IS NOT NULL").distinct()
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest = candidates.agg(F.max(norm)).first()[0] or 0.0
    largest *= 1 + 1e-12
    count = max(1, -(-candidates.count() // TREE_VECTORS))
    trees = packed(candidates, TREE_VECTORS, count)
    hashed = asked.select(F.size("vector").alias("dims"), F.xxhash64("id").alias("home"), F.array("id").alias("ids"), "vector")
    blocks = packed(hashed, QUERY_VECTORS, max(1, -(-asked.count() // QUERY_VECTORS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block")
    sent = blocks.select("dims", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), every)
    schema = "query_id bigint, vec_id bigint, score double"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = (-1, row["dims"])
                vectors, own = (np.frombuffer(row[c], "<f8").reshape(shape) for c in ("vectors", "query_vectors"))
                ids, query_ids = (np.frombuffer(row[c], "<i8") for c in ("ids", "query_ids"))
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                first = np.cumsum(sizes) - sizes
                # One more than k: a query's own vector may be among the found ones.
                which, best = search(vectors, own, min(k + 1, len(vectors)), largest, confidence)
                at, place = np.nonzero(which >= 0)
                group, score = which[at, place], best[at, place]
                n = sizes[group]
                ends = np.cumsum(n)
                names = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[group] - (ends - n), n)]
                asks, score = np.repeat(query_ids[at], n), np.repeat(score, n)
                other = asks != names
                asks, names, score = asks[other], names[other], score[other]
                order = np.lexsort((names, -score, asks))
                asks, names, score = asks[order], names[order], score[order]
                new = np.flatnonzero(np.diff(asks, prepend=asks[:1] - 1 if len(asks) else asks))
                rank = np.arange(len(asks)) - np.repeat(new, np.diff(np.append(new, len(asks))))
                top = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(asks[top]), pa.array(names[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    found = trees.join(sent, ["dims", "block"]).mapInArrow(match, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
