"""Whitening of vectors by their leading principal components, found by a block Jacobi-Davidson method.

The covariance matrix is never formed. What is known of it are its products with a few vectors at a time, each a pass over
blocks of centred integers whose partial sums meet in a tree of tasks. A search space is kept on the driver as its basis and
the basis' products, a few times as many columns as components. Rayleigh-Ritz in it gives approximations; those whose
residuals are at rounding level are locked. For each of the others the correction equation, projected away from the locked
and present vectors, is solved roughly by MINRES, all of them side by side so that they share their products; the corrections
widen the search space, which starts again from its best vectors when it is full. Once it spans the whole space
Rayleigh-Ritz is exact, so few dimensions need few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import lean_worker, removed, written
from patchloom.llm.vector_dup import finite_entries

#: Vectors of a block, and what an entry is scaled by and shifted to as an integer.
BLOCK, SCALE, SHIFT = 4096, 64, 1_000_000
#: Steps of MINRES for a correction, rounds at most, and the search space as a multiple of the components.
INNER, ROUNDS, SPACE = 4, 60, 3
#: Residuals count as rounding below this share of the largest eigenvalue, and as not converged above the second one.
ROUNDED, ACCEPTED = 2e-14, 1e-11

Product = Callable[[np.ndarray], np.ndarray]


def integers(vector: str) -> Column:
    """The entries c of a vector as floor(SCALE * c) + SHIFT; one beyond 62 bits is an error."""
    scaled = lambda c: F.floor(c.cast("double") * SCALE)
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < float(2**56), scaled(c) + SHIFT).otherwise(F.raise_error("an entry is too large").cast("long")))


def _blocks(rows: DataFrame) -> DataFrame:
    """size, kind, x: blocks of the rows' x as little-endian integers, less SHIFT, of the smallest kind that holds them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - SHIFT
            for low in range(0, len(x), BLOCK):
                part = x[low : low + BLOCK]
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["size", "kind", "x"])

    return rows.select("x").mapInArrow(pack, "size long, kind string, x binary")


def _summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """Sum of of_block(integers of a block) over all blocks: within tasks, and then in a tree of tasks."""

    def own(rows: Iterator) -> Iterator[np.ndarray]:
        total = zero
        for row in rows:
            total = total + of_block(np.frombuffer(row.x, row.kind).reshape(row.size, -1))
        yield total

    return blocks.rdd.mapPartitions(own).treeReduce(lambda a, b: a + b, depth=3)


class Centred:
    """The covariance matrix of blocks of integers (divisor n), known by its products. sums are exact."""

    def __init__(self, blocks: DataFrame, size: int) -> None:
        self.blocks, self.size = blocks, size
        # Python's integers in the sums: no overflow however many rows.
        head = _summed(blocks, lambda x: np.append(x.astype(np.int64).sum(0).astype(object), len(x)), np.array([0] * (size + 1), object))
        self.n, self.sums = int(head[-1]), [int(s) for s in head[:-1]]
        #: The means as integers and fractions, so that entries are centred without rounding away their leading digits.
        self.whole = np.array([s // self.n for s in self.sums], np.int64) if self.n else np.zeros(size, np.int64)
        self.part = np.array([(s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(size)

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance matrix times the columns of u."""
        whole, part = self.whole, self.part

        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x, whole, part)
            return c.T @ (c @ u)

        return _summed(self.blocks, of, np.zeros(u.shape)) / self.n

    def trace(self) -> float:
        whole, part = self.whole, self.part
        return float(_summed(self.blocks, lambda x: np.array([(centred(x, whole, part) ** 2).sum()]), np.zeros(1))[0] / self.n)

    def identity_error(self, axes: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the rows projected on axes, less the identity."""
        whole, part, k = self.whole, self.part, axes.shape[1]
        mean = _summed(self.blocks, lambda x: (centred(x, whole, part) @ axes).sum(0), np.zeros(k)) / self.n

        def of(x: np.ndarray) -> np.ndarray:
            w = centred(x, whole, part) @ axes - mean
            return w.T @ w

        return float(np.abs(_summed(self.blocks, of, np.zeros((k, k))) / self.n - np.eye(k)).max())


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) - whole).astype(np.float64) - part


def _orthogonal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the orthonormal basis."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
    q, s, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, s > 1e-10]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def minres(apply: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions x of apply(x) = right for all columns at once, apply acting on each column as a symmetric matrix.

    The Lanczos recurrence and its Givens rotations, a column's numbers standing in arrays.
    """
    beta = np.linalg.norm(right, axis=0)
    safe = lambda b: np.where(b > 0, b, 1.0)
    v, before, x = right / safe(beta), np.zeros_like(right), np.zeros_like(right)
    left, c, s, c_old, s_old = beta, np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    d, d_old, beta = np.zeros_like(right), np.zeros_like(right), np.zeros_like(beta)
    for _ in range(steps):
        w = apply(v) - beta * before
        alpha = (w * v).sum(0)
        w = w - alpha * v
        beta_next = np.linalg.norm(w, axis=0)
        # Two rotations act on the new column of the tridiagonal matrix; a third one makes its last entry zero.
        third, rest = s_old * beta, c_old * beta
        second, diagonal = c * rest + s * alpha, c * alpha - s * rest
        c_old, s_old = c, s
        length = np.hypot(diagonal, beta_next)
        c, s = np.where(length > 0, diagonal / safe(length), 1.0), np.where(length > 0, beta_next / safe(length), 0.0)
        d_new = np.where(length > 0, (v - second * d - third * d_old) / safe(length), 0.0)
        x = x + c * left * d_new
        left = -s * left
        before, v = v, w / safe(beta_next)
        d_old, d, beta = d, d_new, beta_next
    return x


def leading_eigenpairs(product: Product, size: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix known by its products."""
    k, most = min(k, size), min(size, max(SPACE * k, k + 8))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, k)))[0]
    images = product(basis)
    worst = np.inf
    for _ in range(ROUNDS):
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        ritz, ritz_images = basis @ turn, images @ turn
        residual = ritz_images[:, :k] - ritz[:, :k] * values[:k]
        norms, scale = np.linalg.norm(residual, axis=0), max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
        worst = norms.max() / scale
        open_ = np.flatnonzero(norms > ROUNDED * scale)
        if not len(open_) or basis.shape[1] == size:
            break
        if basis.shape[1] + len(open_) > most and basis.shape[1] > k:  # start again from the locked and best vectors
            keep = min(basis.shape[1], max(k + 4, most - len(open_)))
            basis, images = np.linalg.qr(ritz[:, :keep])[0], None
            images = product(basis)
            ritz = basis
        locked, theta = ritz[:, :k], values[open_]
        away = lambda y, q=locked: y - q @ (q.T @ y)
        t = minres(lambda y, a=away, theta=theta: a(product(a(y)) - a(y) * theta), -away(residual[:, open_]), INNER)
        new = _orthogonal(np.concatenate([t, residual[:, open_]], axis=1) if basis.shape[1] + 2 * len(open_) <= most else t, basis)[:, : size - basis.shape[1]]
        if not new.shape[1]:
            new = _orthogonal(np.random.default_rng(seed + 1).standard_normal((size, 1)), basis)
        basis, images = np.concatenate([basis, new], axis=1), np.concatenate([images, product(new)], axis=1)
    # The images carry the rounding of several passes; one fresh product of the vectors themselves settles values and angles.
    ritz = np.linalg.qr(ritz[:, :k])[0]
    image = product(ritz)
    inner = ritz.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    vectors, values = ritz @ turn[:, ::-1], values[::-1]
    worst = np.linalg.norm(image @ turn[:, ::-1] - vectors * values, axis=0).max() / max(abs(values[0]), np.finfo(float).tiny)
    if values[0] > 0 and worst > ACCEPTED:
        raise ArithmeticError(f"residuals of {worst:.1e} of the largest eigenvalue after {ROUNDS} rounds")
    return values, vectors


def whitened(df: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the whitened entries of each row of df.

    Entries c of vectors become integers x = floor(64 * c) + 1000000. Components are the unit eigenvectors of the x's covariance
    (divisor n, the number of vectors used), numbered from 1 by falling eigenvalue e, of either sign. whitened is
    the centred x projected on the component, over sqrt(e); deviation the exact sum of (n * x - sum of x)^2 as a decimal of
    38 digits; explained is e over the covariance's trace; identity_error the largest absolute entry of the whitened values'
    covariance less the identity. Rows whose vector is null, empty or holds a null or an entry that isn't finite are left
    out, and so are vectors of another length than the commonest one (of the longest of these). Components whose eigenvalue
    is zero but for rounding have no whitened values and are left out: a single vector, equal vectors and an empty table
    give no rows. Repeated rows count again. Other columns of df are ignored. An x beyond 64 bits is an error.
    """
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(finite_entries(F.col("vector")) & (F.size("vector") > 0))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    size = lengths["size"]
    rows = rows.filter(F.size("vector") == size).select("vec_id", integers("vector").alias("x"))
    blocks = written(_blocks(rows), "vector-blocks")
    matrix = Centred(blocks, size)
    trace = matrix.trace()
    if trace == 0:
        removed(blocks)
        return spark.createDataFrame([], schema)
    values, vectors = leading_eigenpairs(matrix.product, size, components)
    good = values > values[0] * size * np.finfo(float).eps * 8
    values, axes = values[good], vectors[:, good] / np.sqrt(values[good])
    error = matrix.identity_error(axes)
    removed(blocks)
    return rows.mapInPandas(partial(_projected, matrix.n, matrix.sums, matrix.whole, matrix.part, axes, values / trace, error), schema)


def _projected(n: int, sums: list[int], whole: np.ndarray, part: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    k, rest = axes.shape[1], np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)], object)
    rests = int((rest**2).sum())
    for batch in batches:
        for low in range(0, len(batch), 1024):
            own = batch.iloc[low : low + 1024]
            x = np.stack(own["x"].to_numpy()) - SHIFT
            near = x - whole
            # n * x - S is n * near - rest; its square is summed up by parts, in integers that can't overflow.
            largest = int(np.abs(near).max())
            exact = np.int64 if len(part) * largest * max(n, largest) < 2**62 else object
            squares, cross = (near.astype(exact) ** 2).sum(1), near.astype(exact) @ rest.astype(exact)
            deviation = [Decimal(n * n * int(a) - 2 * n * int(b) + rests) for a, b in zip(squares, cross, strict=True)]
            w = (near.astype(np.float64) - part) @ axes
            yield pd.DataFrame({
                "vec_id": own["vec_id"].astype("Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": n,
                "deviation": np.repeat(np.array(deviation, object), k), "whitened": w.ravel(), "explained": np.tile(explained, len(x)), "identity_error": error,
            })
