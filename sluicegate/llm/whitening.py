"""Whitening of embeddings: covariances from exact variances of dimensions and of sums of two dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows whose pair sums are squared together.
ROWS = 4096
#: A component whose eigenvalue is below this share of the largest has no variance but rounding.
LEAST_SHARE = 1e-12
BIG = "decimal(38,0)"
WHITENED = f"vec_id bigint, component int, n bigint, deviation {BIG}, whitened double, explained double"


def fixed_point(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x, longs floor(SCALE * c) + SHIFT, of rows whose vector has entries, none null or non-finite.

    An entry that a long cannot hold is an error.
    """
    typed = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    # The condition is in the value, so that no filter derived from it meets entries that do not convert.
    return typed.select("vec_id", F.when((F.size("v") > 0) & ~bad, whole).alias("x")).where(F.col("x").isNotNull())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1)


def _squares(values: np.ndarray) -> list[int]:
    """The exact sum of squares of every column; Python's integers take over where 64 bits might not do."""
    if not values.size:
        return [0] * values.shape[1]
    most = max(abs(int(values.min())), abs(int(values.max())))
    if most * most * len(values) < 1 << 63:
        return np.einsum("ij,ij->j", values, values).tolist()
    return [sum(v * v for v in column) for column in values.T.tolist()]


@dataclass(frozen=True)
class Moments:
    """Rows, exact sums and the exact covariance matrix (numerators of a common divisor n ** 2)."""

    n: int
    sums: list[int]
    scatter: list[list[int]]

    @property
    def covariance(self) -> np.ndarray:
        return np.array([[float(Fraction(v, self.n * self.n)) for v in row] for row in self.scatter])


def moments(points: DataFrame) -> Moments | None:
    """Two passes: sums of every dimension, then squares of centred dimensions and of centred sums of two.

    With y the centred values, 2 cov(i, j) = var(y_i + y_j) - var(y_i) - var(y_j). Values are centred on the mean's
    integer part, and its rest is taken off the sums of squares at the end, in integers; so nothing is rounded. A task
    sends one row per dimension and pair, added up as decimals of 38 digits. None for a table without rows;
    vectors of several lengths are an error.
    """
    lengths = points.agg(F.min(F.size("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not lengths[2]:
        return None
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} entries")
    d, n = int(lengths[0]), int(lengths[2])
    # Halves of 32 bits add up in longs for 2 ** 31 rows and more; beyond a long the sum is an error.
    high, low = F.shiftright("value", 32), F.col("value").bitwiseAND((1 << 32) - 1)
    halves = points.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(F.sum(high).alias("high"), F.sum(low).alias("low"))
    found = {r["i"]: (r["high"] << 32) + r["low"] for r in halves.collect()}
    sums = [found[i] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, dtype=np.int64)
        total = [[0] * (d - i) for i in range(d)]
        for batch in batches:
            whole = _matrix(batch)
            for at in range(0, len(whole), ROWS):
                y = whole[at : at + ROWS] - middle
                for i in range(d):
                    # The first column is the dimension itself, the others its sums with later ones.
                    pairs = y[:, i:] + y[:, i : i + 1]
                    pairs[:, 0] = y[:, i]
                    total[i] = [a + b for a, b in zip(total[i], _squares(pairs), strict=True)]
        i, j = zip(*((i, j) for i in range(d) for j in range(i, d)), strict=True)
        values = [Decimal(v) for row in total for v in row]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "q"])

    squared = points.select("x").mapInArrow(square, f"i int, j int, q {BIG}").groupBy("i", "j").agg(F.sum("q").alias("q"))
    # At most d * (d + 1) / 2 rows, whatever the number of vectors.
    q = {(r["i"], r["j"]): int(r["q"]) for r in squared.collect()}
    # n ** 2 times a variance is n * q - r ** 2, r being what the integer centre leaves of the sum.
    own = [n * q[i, i] - rest[i] ** 2 for i in range(d)]
    scatter = [[0] * d for _ in range(d)]
    for (i, j), v in q.items():
        twice = n * v - (rest[i] + rest[j]) ** 2 - own[i] - own[j]
        scatter[i][j] = scatter[j][i] = own[i] if i == j else twice // 2
    return Moments(n, sums, scatter)


@dataclass(frozen=True)
class Whitener:
    """The fitted transformation: components as columns, by falling eigenvalue."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fit(cls, found: Moments, components: int = COMPONENTS) -> Whitener:
        values, vectors = np.linalg.eigh(found.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        return cls(found, values[order], vectors[:, order])

    @property
    def live(self) -> np.ndarray:
        return self.values > max(self.values[0], 0.0) * LEAST_SHARE

    @property
    def explained(self) -> np.ndarray:
        trace = float(Fraction(sum(row[i] for i, row in enumerate(self.moments.scatter)), self.moments.n**2))
        return self.values / trace if trace > 0 else np.full(len(self.values), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the mean's integer part is taken off exactly, then its fraction."""
        n = self.moments.n
        whole = np.array([s // n for s in self.moments.sums], dtype=np.int64)
        part = np.array([float(Fraction(s % n, n)) for s in self.moments.sums])
        return (x - whole) - part

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; components without variance are nan."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of (n * x - S) ** 2."""
        n, sums = self.moments.n, self.moments.sums
        reach = n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(map(abs, sums)) if x.size else 0
        if reach < 1 << 62:
            gap = x * n - np.array(sums, dtype=np.int64)
            most = max(abs(int(gap.min())), abs(int(gap.max()))) if gap.size else 0
            if most * most * x.shape[1] < 1 << 63:
                return np.einsum("ij,ij->i", gap, gap).tolist()
        return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def identity_error(points: DataFrame, whitener: Whitener) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    live = np.flatnonzero(whitener.live)
    if not len(live):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((len(live), len(live))), np.zeros(len(live))
        for batch in batches:
            w = whitener.project(_matrix(batch))[:, live]
            total, first = total + w.T @ w, first + w.sum(axis=0)
        i, j = np.indices(total.shape)
        i, j, v = np.append(i.ravel(), np.arange(len(live))), np.append(j.ravel(), np.full(len(live), -1)), np.append(total.ravel(), first)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["i", "j", "v"])

    added = points.select("x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    n = whitener.moments.n
    found = {(r["i"], r["j"]): r["v"] / n for r in added.collect()}
    # Rows are centred before they are multiplied; what rounding leaves of their mean is taken off.
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(len(live)) for j in range(len(live)))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per remaining row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors without entries.
    Null and repeated vec_ids are carried row by row; other columns are ignored. ``rows`` is read several times, so it
    should be a stored table. A component without variance (fewer distinct rows than dimensions) has a null
    ``whitened``, and its ``explained`` is 0 or, where nothing varies, null. An empty table gives an empty one.
    ``deviation`` is an exact decimal. Vectors of several lengths are an error.
    """
    spark = rows.sparkSession
    points = fixed_point(rows, vec_id, vector)
    found = moments(points)
    if found is None:
        return spark.createDataFrame([], f"{WHITENED}, identity_error double")
    whitener = Whitener.fit(found, components)
    error = identity_error(points, whitener)
    explained = [None if np.isnan(e) else max(float(e), 0.0) for e in whitener.explained]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(whitener.values)
        for batch in batches:
            x = _matrix(batch)
            w = whitener.project(x)
            rows_, each = len(x), np.repeat(np.arange(len(x)), kept)
            ids = batch.column("vec_id").take(pa.array(each))
            deviation = pa.array([Decimal(v) for v in whitener.deviations(x)], pa.decimal128(38, 0)).take(pa.array(each))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * kept, found.n)),
                    deviation,
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(explained * rows_, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return points.mapInArrow(transform, WHITENED).withColumn("identity_error", F.lit(error).cast("double"))
