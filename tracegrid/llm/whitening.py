"""Whitening of embeddings by Jacobi-Davidson: the covariance matrix is only ever multiplied with, never formed.

A product with a block of vectors is one pass over the vectors to fit: each task centres its rows before it multiplies and
gives one partial sum, of the size of the block. The driver holds blocks of as many numbers as the vectors have dimensions,
times the components: the search space, its products, and the Ritz vectors. From the search space come Ritz vectors;
those whose residual isn't down to double precision get a correction equation each, projected off all Ritz vectors and
locked ones, solved in part by MINRES (all in step, so that one pass serves them all); the corrections widen the search
space, which restarts from its best Ritz vectors when it is full. Components are locked from the largest on.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^40 or more in size, are
dropped; so are rows of another length than most rows have (the longer of equals). Repeated vectors count once in the fit
and each get their rows. Rows without an id stay. Components whose eigenvalue is 0 to double precision can't be whitened and
are left out, so that one vector alone, or equal ones, give no rows; an empty table gives an empty result. A deviation
beyond 64 bits is null. Other columns are not part of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import finished, materialize, table

SHIFT = 1_000_000
#: Partial sums that the driver takes at once, in bytes; beyond, executors add them up first.
AT_ONCE = 32 << 20
EPS = float(np.finfo(float).eps)


def _rows(batch: pa.RecordBatch, place: int, dims: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed(df: DataFrame, tasks: int, one: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what one() gives for each of df's tasks: a block of doubles of that shape, whatever the table's size."""
    most = max(2, AT_ONCE // (8 * int(np.prod(shape))))

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(one(batches), dtype=float).tobytes()], pa.binary())], ["part"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([sum(np.frombuffer(x) for x in group.column("part").to_pylist()).tobytes()], pa.binary())})

    parts = df.mapInArrow(run, "part binary")
    if tasks > most:
        parts = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(most))).groupBy("k").applyInArrow(add, "part binary")
    total = np.zeros(int(np.prod(shape)))
    for row in parts.collect():
        total += np.frombuffer(row.part)
    return total.reshape(shape)


@dataclass
class Vectors:
    """The distinct vectors to fit, as integers less SHIFT (column x), with their count, sums and length."""

    df: DataFrame
    tasks: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def products(self, block: np.ndarray) -> np.ndarray:
        """The covariance matrix times block."""
        mean, dims, n = self.mean, len(self.sums), self.n

        def one(batches):
            out = np.zeros(block.shape)
            for b in batches:
                x = _rows(b, 0, dims) - mean
                out += x.T @ (x @ block)
            return out

        return summed(self.df, self.tasks, one, block.shape) / n

    def trace(self) -> float:
        mean, dims = self.mean, len(self.sums)
        return float(summed(self.df, self.tasks, lambda batches: np.array([sum((((_rows(b, 0, dims) - mean) ** 2).sum() for b in batches), 0.0)]), (1,))[0]) / self.n


def scaled(vector: Column) -> Column:
    """floor(64 c) of each entry c as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the integers, of df's rows whose vectors can be fitted."""
    df = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 40), F.lit(False)))
    d = df.where(fine)
    common = d.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common.dims if common else 0
    return d.where(F.size(v) == dims).select("id", scaled(v).alias("x"))


def gathered(rows: DataFrame) -> Vectors:
    """The distinct vectors of rows (column x), written, with their sums."""
    df = materialize(rows.select("x").distinct(), "whitening-distinct")
    # A sum of long numbers could pass 64 bits; decimals don't.
    sums = df.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("pos").collect()
    return Vectors(df, df.rdd.getNumPartitions(), sums[0].n if sums else 0, [int(r.s) for r in sums])


def _orthogonal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal columns of against."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    block = u[:, s > 1e-8 * s[0]]
    block = block - against @ (against.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def _corrections(products, theta: np.ndarray, held: np.ndarray, residual: np.ndarray, turns: int, goal: float) -> np.ndarray:
    """Approximate solutions t of P (V - theta I) P t = -r for each column, P off the columns of held: MINRES, all columns in
    step, so that a turn is one product. A column ends when its residual is goal of what it was."""
    off = lambda x: x - held @ (held.T @ x)
    v = off(off(-residual))
    beta = np.linalg.norm(v, axis=0)
    first = np.maximum(beta, 1e-300)
    v, last = v / first, np.zeros_like(v)
    out, d0, d1 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c0, s0, c1, s1 = -np.ones_like(beta), np.zeros_like(beta), -np.ones_like(beta), np.zeros_like(beta)
    eta, open_, beta_in = beta.copy(), beta > 0, np.zeros_like(beta)
    for _ in range(turns):
        if not open_.any():
            break
        w = np.zeros_like(v)
        w[:, open_] = off(products(v[:, open_]) - v[:, open_] * theta[open_])
        alpha = (v * w).sum(axis=0)
        w = off(w - v * alpha - last * beta_in)
        beta_out = np.linalg.norm(w, axis=0)
        # Two rotations from before, then the one that clears the entry below the diagonal.
        r3 = s0 * beta_in
        mid = -c0 * beta_in
        r2 = c1 * mid + s1 * alpha
        low = s1 * mid - c1 * alpha
        r1 = np.hypot(low, beta_out)
        safe = np.where(r1 > 0, r1, 1.0)
        c2, s2 = np.where(r1 > 0, low / safe, -1.0), np.where(r1 > 0, beta_out / safe, 0.0)
        d2 = np.where(open_ & (r1 > 0), (v - d1 * r2 - d0 * r3) / safe, 0.0)
        out = out + d2 * np.where(open_, c2 * eta, 0.0)
        eta = np.where(open_, s2 * eta, eta)
        last, v = v, w / np.where(beta_out > 0, beta_out, 1.0)
        d0, d1, c0, s0, c1, s1, beta_in = d1, d2, c1, s1, c2, s2, beta_out
        open_ = open_ & (np.abs(eta) > goal * first) & (beta_out > 1e-14 * first)
    return out


def leading(products: Callable[[np.ndarray], np.ndarray], dims: int, k: int, *, guard: int = 4, inner: int = 6, full: int | None = None, tolerance: float = 64 * EPS, turns: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric positive matrix, their vectors, and the largest residual against the largest
    eigenvalue. products multiplies a block. guard more vectors are iterated than are asked for, full bounds the search space."""
    k = min(k, dims)
    m = min(k + guard, dims)
    full = min(dims, full or 3 * m)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, m)))[0]
    image = products(basis)
    best, still = np.inf, 0
    for _ in range(turns):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, moved = basis @ s[:, :m], image @ s[:, :m]
        theta_m, top = theta[:m], max(theta[0], 0.0)
        residual = moved - ritz * theta_m
        size = np.linalg.norm(residual, axis=0)
        done = size <= tolerance * top
        locked = int(np.argmin(np.append(done[:k], False)))  # the largest ones, all in a row
        worst = size[:k].max() / top if top > 0 else 0.0
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        if locked == k or top <= 0 or (still >= 3 and worst < 1e-12):
            return theta_m[:k], ritz[:, :k], worst
        todo = np.flatnonzero(~done)
        t = _corrections(products, theta_m[todo], ritz, residual[:, todo], inner, 0.01)
        if basis.shape[1] + len(todo) > full:
            keep = min(m, full - len(todo)) if full > len(todo) else m
            keep = max(keep, min(m, full))
            basis, image = basis @ s[:, :keep], image @ s[:, :keep]
            q, r = np.linalg.qr(basis)  # rounding of many restarts
            basis, image = q, np.linalg.solve(r.T, image.T).T
        new = _orthogonal(np.where(np.isfinite(t), t, 0.0), basis)
        if not new.shape[1]:
            new = _orthogonal(residual[:, todo], basis)
        if not new.shape[1]:
            return theta_m[:k], ritz[:, :k], worst
        basis, image = np.hstack([basis, new]), np.hstack([image, products(new)])
    raise ArithmeticError(f"residuals stay at {worst:.1e} of the largest eigenvalue")


@dataclass
class Whitener:
    """Components as columns, their eigenvalues and shares of the trace, and how far the fit's whitened covariance is off the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float
    residual: float


def fit(rows: DataFrame, k: int = 16, **how) -> Whitener:
    """A whitener of the distinct vectors of rows (column x)."""
    v = gathered(rows)
    if not v.n:
        return Whitener(0, v.sums, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    dims, mean = len(v.sums), v.mean
    values, components, residual = leading(v.products, dims, k, **how)
    some = values > dims * 64 * EPS * max(values[0], 0.0)
    values, components = values[some], components[:, some]
    if not len(values):
        return Whitener(v.n, v.sums, values, components, values, 0.0, residual)
    scale = components / np.sqrt(values)

    def one(batches):
        out = np.zeros((len(values), len(values)))
        for b in batches:
            w = (_rows(b, 0, dims) - mean) @ scale
            out += w.T @ w
        return out

    off = summed(v.df, v.tasks, one, (len(values), len(values))) / v.n - np.eye(len(values))
    return Whitener(v.n, v.sums, values, components, values / v.trace(), float(np.abs(off).max()), residual)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 for each row, exact; null beyond 64 bits."""
    far = max((abs(float(n) * lim - s) for s in sums for lim in (float(x.min()), float(x.max()))), default=0.0) if len(x) else 0.0
    if far**2 * len(sums) < 2.0**62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, w: Whitener, id_col: str = "id") -> DataFrame:
    """A row for each row and component: id, component, n, deviation, whitened, explained and identity_error."""
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *map(T.StructField, names[1:], kinds)])
    k, dims = len(w.values), len(w.sums)
    mean = np.array([float(Fraction(s, w.n)) for s in w.sums]) if w.n else np.zeros(0)
    scale = w.components / np.sqrt(w.values) if k else w.components

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows if k else 0, 1024):
                part = b.slice(at, 1024)
                x = _rows(part, 1, dims)
                each = np.repeat(np.arange(len(x)), k)
                n = len(each)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, w.n, dtype=np.int64)),
                    pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(each)), pa.array(((x - mean) @ scale).ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(n, w.identity_error)),
                ], names)

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and component with what the whitening of its row by that component is."""

    def make() -> DataFrame:
        rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
        return whiten(rows, fit(rows), "vec_id")

    return finished(spark, make, "whitening")
