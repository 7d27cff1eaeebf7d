"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries c become whole numbers x = floor(64 c) + 1,000,000. Three passes over the vectors, each a sum
of small tables that tasks make of their rows:

1. n and the sums S.
2. The scatter. Vectors are centred at the whole numbers nearest to the means before they are
   multiplied, so that products are small; what is left of the means is taken off exactly. Sums
   are whole numbers, so that the scatter is exact and doesn't depend on the order of rows.
3. Each vector's projections, and their covariance as measured.

The scatter A is factored as P L L' P' by Cholesky with the largest remaining diagonal as pivot, which
ends at the rank. One-sided Jacobi rotates pairs of columns of L until all are orthogonal: L J = U D.
The squares of the column norms D are A's eigenvalues and the columns of U, normalised, its
eigenvectors; A itself is not squared or diagonalised. Only tables of d by d numbers come to the driver.

Components whose eigenvalue is zero (beyond the rank, as for constant or dependent dimensions) have no
whitened value and no rows. Rows go whose vector is null, empty, or holds null or non-finite entries, or entries
beyond 2^46, of which x would not be exact; so do those whose length is not the most frequent one (of
equally frequent ones the smaller). Equal vectors, also of one id, each count. Without rows the result is
empty. ``deviation`` is exact; null if it is beyond a long. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 46)
ROWS = 2048  # vectors worked on at once
SAFE = 1 << 62


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids' places and x of the vectors, some rows at a time."""
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            flat = part["v"].flatten().to_numpy().reshape(len(part), -1)
            yield part, (np.floor(SCALE * flat) + SHIFT).astype(np.int64)


def whole_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left' right in whole numbers; of Python's own where a long could overflow."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * len(left)
    if most < 1 << 53:  # exact in doubles, and faster there
        return (left.T.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left.T @ right if most < SAFE else left.T.astype(object) @ right.astype(object)


def table_rows(name: str, values: np.ndarray) -> pa.RecordBatch:
    """One row for each row of a table of whole numbers, entries as decimal strings (they may exceed a long)."""
    values = np.atleast_2d(values)
    rows = [[str(int(x)) for x in row] for row in values]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["name", "i", "row"])


def summed(frame: DataFrame, work) -> dict[str, list[list[int]]]:
    """The sums, by place, of the tables that tasks give: d rows of d entries at most on the driver."""
    cells = frame.mapInArrow(work, "name string, i int, row array<string>").select("name", "i", F.posexplode("row").alias("j", "x"))
    found = cells.groupBy("name", "i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    tables: dict[str, list[list[int]]] = {}
    for r in sorted(found.collect()):
        rows = tables.setdefault(r.name, [])
        rows += [[] for _ in range(r.i + 1 - len(rows))]
        rows[r.i].append(int(r.x))
    return tables


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for _, x in matrices(batches):
        part = whole_product(np.ones((len(x), 1), np.int64), x)[0].astype(object)
        n, total = n + len(x), part if total is None else total + part
    if n:
        yield table_rows("n", np.array([n]))
        yield table_rows("sum", total)


def products(middle: list[int]):
    """Sums of products of vectors that are centred at ``middle``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches):
            y = x - np.array(middle, np.int64)
            part = whole_product(y, y)
            total = part.astype(object) if total is None else total + part
        if total is not None:
            yield table_rows("products", total)

    return work


def scatter(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The sum of (x - S/n)(x - S/n)' in doubles, each entry rounded once."""
    middle = [(2 * s + n) // (2 * n) for s in total]
    left = [s - n * m for s, m in zip(total, middle)]  # n times what is left of the means
    found = summed(rows, products(middle))["products"]
    return np.array([[(n * x - a * b) / n for x, b in zip(row, left)] for row, a in zip(found, left)])


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor L (d by rank, its rows in A's order) with A = L L'.

    At each step the largest remaining diagonal is the pivot, among those with more left than
    rounding of what they began with.
    """
    rest, columns = np.diag(a).astype(np.float64).copy(), []
    floor = 8 * len(a) * np.finfo(np.float64).eps * rest
    done = np.zeros(len(a), bool)
    for _ in range(len(a)):
        pivot = int(np.argmax(np.where(done | (rest <= floor), -np.inf, rest)))
        if done[pivot] or rest[pivot] <= floor[pivot]:
            break
        before = np.array(columns).reshape(len(columns), len(a))
        column = (a[:, pivot] - before.T @ before[:, pivot]) / np.sqrt(rest[pivot])
        column[done] = 0.0
        column[pivot] = np.sqrt(rest[pivot])
        done[pivot] = True
        rest = rest - column**2
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(a)).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared column norms, falling, and normalised columns of the factor, rotated until they are orthogonal."""
    u = np.array(factor, np.float64, order="F")
    k = u.shape[1]
    small = max(len(u), 1) * np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for p in range(k - 1):
            for q in range(p + 1, k):
                a, b, c = u[:, p] @ u[:, p], u[:, q] @ u[:, q], u[:, p] @ u[:, q]
                if abs(c) <= small * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, t)
                sine = cosine * t
                u[:, p], u[:, q] = cosine * u[:, p] - sine * u[:, q], sine * u[:, p] + cosine * u[:, q]
        if not turned:
            break
    values = (u**2).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


def projected(n: int, total: list[int], axes: np.ndarray, scale: np.ndarray):
    """id, deviation and the whitened values of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(total, object)
        middle = (2 * s + n) // (2 * n)
        rest = np.array([a / n for a in s - n * middle], np.float64)
        for part, x in matrices(batches):
            y = (x - middle.astype(np.int64)).astype(np.float64) - rest
            white = (y @ axes) / scale
            off = x.astype(object) * n - s if n * (int(np.abs(x).max()) + 1) >= SAFE or max(map(abs, total)) >= SAFE else x * n - s.astype(np.int64)
            if off.dtype == object or int(np.abs(off).max()) ** 2 * off.shape[1] >= SAFE:
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((off**2).sum(axis=1))
            ends = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([part["id"], deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["id", "deviation", "white"])

    return work


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whitened vectors (row 0) and of their products."""
    total = None
    for batch in batches:
        w = batch["white"].flatten().to_numpy().reshape(len(batch), -1)
        part = np.concatenate([w.sum(axis=0)[None], w.T @ w])
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    cells = white.select("white").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    found = np.zeros((k + 1, k))
    for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        found[r.i, r.j] = r.x
    mean = found[0] / n
    return float(np.abs(found[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(usable(F.col("v")))
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("v") == lengths.d)
    found = summed(vectors.select("v"), sums)
    n, total = found["n"][0][0], found["sum"][0]
    values, axes = one_sided_jacobi(pivoted_cholesky(a := scatter(vectors.select("v"), n, total)))
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], schema)
    values, axes = values[:k] / n, axes[:, :k]
    white = cut(vectors.mapInArrow(projected(n, total, axes, np.sqrt(values)), f"id {kind}, deviation long, white array<double>"))
    explained = F.array(*map(F.lit, (values / (np.trace(a) / n)).tolist()))
    out = white.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(vec_id), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(white, n, k)).alias("identity_error"),
    )
