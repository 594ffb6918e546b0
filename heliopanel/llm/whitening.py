"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Entries become whole numbers floor(256 c), so that equal vectors are found and sums are exact. The mean and the
centred covariance of the distinct vectors are two Spark aggregates: tasks add up what they hold and hand on one
row of a sum per dimension, whatever the number of vectors. The covariance, a matrix of D x D numbers, is split on the
driver: the polar factor of the covariance shifted by s, found by the dynamically weighted Halley iteration, is +1 on
the eigenvectors above s and -1 on those below; half of it plus half the identity projects on the upper
invariant subspace. Both subspaces are split again, the lower one only if the upper one is too small, until each
holds one component. The D x k whitening matrix is the only thing that is broadcast.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of each length are whitened
on their own; an empty vector has no components. Entries beyond +-2^40 count as +-2^40. A component whose
eigenvalue is zero to double precision has null `whitened` and counts in no `identity_error`; `explained` is null where all
vectors are equal. `deviation` is null beyond 2^63. Eigenvectors of equal eigenvalues are any basis of their
space. Repeated rows and identifiers are further rows, null identifiers stay null. An empty table gives an
empty result. Columns of the input named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from heliopanel.llm.common import col, stored

SCALE = 256
LARGEST = 1 << 40
EPS = np.finfo(np.float64).eps
ROWS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix, by QR-based QDWH."""
    n = len(a)
    size = np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    if size == 0:
        return np.eye(n)
    x = a / size
    low = EPS  # smaller singular values do not matter to double precision
    eye = np.eye(n)
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / square ** 2) ** (1 / 3) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(after - x)
        x = after
        if abs(low - 1) < 10 * EPS and moved < 10 * EPS ** (1 / 3):
            break
    return x


def bases(a: np.ndarray, shift: float, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if the shift does not divide cleanly."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    trace = np.trace(projector)
    k = int(round(trace))
    if not 0 < k < n or abs(trace - k) > 1e-3:
        return None
    start = np.random.default_rng(0).normal(size=(n, k))
    for _ in range(3):  # subspace iteration; one round is enough for a clean projector
        q, _ = np.linalg.qr(projector @ start, mode="complete")
        upper, lower = q[:, :k], q[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= tolerance:
            return upper, lower
        start = upper
    return None


def largest_components(a: np.ndarray, k: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their eigenvectors as columns."""
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    middle = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - middle * np.eye(n)) <= 4 * n * EPS * scale:
        order = np.argsort(-np.diag(a), kind="stable")[:k]
        return np.diag(a)[order], np.eye(n)[:, order]
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    # The mean always lies between the eigenvalues, the median of the diagonal divides them more evenly.
    shifts = [np.median(np.diag(a)), middle, *(middle + f * spread for f in (0.31, -0.31, 0.73, -0.73, 0.11, -0.11, 1.3, -1.3, 0.03, -0.03))]
    for tolerance in (8 * n * EPS * scale, 1e4 * n * EPS * scale):
        for shift in shifts:
            parts = bases(a, shift, tolerance)
            if parts is not None:
                upper, lower = parts
                values, vectors = largest_components(upper.T @ a @ upper, k, scale)
                vectors = upper @ vectors
                if len(values) < k:
                    more, others = largest_components(lower.T @ a @ lower, k - len(values), scale)
                    values, vectors = np.append(values, more), np.hstack([vectors, lower @ others])
                return values, vectors
    raise ArithmeticError("no shift divides the spectrum")


def components_of(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors, refined by Rayleigh quotients; the largest entry of each vector is positive."""
    k = min(k, len(covariance))
    values, vectors = largest_components(covariance, k)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,jk,ki->i", vectors.T, covariance, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors * signs


def whole(vector: Column) -> Column:
    """Entries as whole numbers."""
    def entry(c: Column) -> Column:
        return F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")
    return F.transform(vector, entry)


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(vectors: DataFrame, dims: int, step, width: int, kind: str) -> np.ndarray:
    """Sum over all tasks of what `step` makes of blocks of vectors: an array of `dims` rows and `width` columns."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for low in range(0, len(x), ROWS):
                part = step(x[low:low + ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(list(total))})

    parts = vectors.select("x").mapInArrow(partial, f"i int, v array<{kind}>")
    sums = [F.sum(F.col("v")[j].cast("decimal(38,0)") if kind == "bigint" else F.col("v")[j]).alias(f"s{j}") for j in range(width)] if width <= 4 else None
    if sums:
        rows = parts.groupBy("i").agg(*sums).orderBy("i").collect()
        return np.array([[int(v) if kind == "bigint" else v for v in r[1:]] for r in rows], object if kind == "bigint" else np.float64)
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # D x D numbers
    out = np.zeros((int(cells["i"].max()) + 1, width))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 2^63."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def _of_length(rows: DataFrame, distinct: DataFrame, dims: int, k: int) -> DataFrame:
    fit = distinct.where(F.col("dims") == dims)
    totals = _summed(fit, dims, lambda x: np.column_stack([x.sum(axis=0), np.full(dims, len(x))]), 2, "bigint")
    n, sums = int(totals[0, 1]), [int(v) for v in totals[:, 0]]
    mean = np.array([v / n for v in sums])
    covariance = _summed(fit, dims, lambda x: _centred(x, mean).T @ _centred(x, mean), dims, "double") / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = components_of(covariance, k)
    trace = float(np.trace(covariance))
    solid = values > dims * EPS * max(values.max(), 0)
    to_white = vectors[:, solid] / np.sqrt(values[solid])
    m = int(solid.sum())
    error = 0.0
    if m:
        def moments(x: np.ndarray) -> np.ndarray:
            z = _centred(x, mean) @ to_white
            return np.column_stack([z.T @ z, z.sum(axis=0)])

        measured = _summed(fit, dims, moments, m + 1, "double") / n
        middle = measured[:, m]
        error = float(np.abs(measured[:, :m] - np.outer(middle, middle) - np.eye(m)).max())
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((mean, to_white, sums))  # D x (k + 2) numbers
    explained = [float(v / trace) if trace > 0 else None for v in values]
    place = np.flatnonzero(solid)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, to_white, sums = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            z = np.full((len(x), len(values)), np.nan)
            z[:, place] = _centred(x, mean) @ to_white
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))],
                                             names=["row", "deviation", "white"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("deviation", LongType()), StructField("white", ArrayType(DoubleType()))])
    out = rows.where(F.col("dims") == dims).select("row", "x").mapInArrow(whitened, schema)
    shares = F.array(*[F.lit(v).cast("double") for v in explained])
    cells = out.select("row", "deviation", F.posexplode("white").alias("i", "w"))
    return cells.select("row.*", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get(shares, F.col("i")).alias("explained"),
                        F.lit(error).alias("identity_error"))


OUTPUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(df: DataFrame, vector: str = "embedding", k: int = 4) -> DataFrame:
    """One row per usable row and component up to k: the other columns, and those of `OUTPUT`."""
    kept = [c for c in df.columns if c != vector and c.lower() not in OUTPUT]
    held = F.struct(*[col(c).alias(c) for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_"))
    rows = df.where(usable(col(vector)) & (F.size(col(vector)) > 0)).select(held.alias("row"), whole(col(vector)).alias("x")).withColumn("dims", F.size("x"))
    distinct = stored(rows.select("x", "dims").distinct())
    lengths = [r[0] for r in distinct.select("dims").distinct().orderBy("dims").toLocalIterator()]
    if not lengths:
        empty = df.where("false").select(*[col(c) for c in kept])
        return empty.select("*", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    out = reduce(DataFrame.unionByName, [_of_length(rows, distinct, d, k) for d in lengths])
    return out if kept else out.drop("_")
