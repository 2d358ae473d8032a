"""Dense row matrices in DataFrames: Gramian, products, eigenvalues, singular values; sliding windows and tree sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns up to which a Gramian is made.
MAX_COLUMNS = 65_535


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.cast(pa.list_(pa.float64()))
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def gramian(rows: DataFrame, column: str) -> DataFrame:
    """(i, j, value), i <= j, of the transposed matrix times the matrix; each task sends one partial product."""

    def partial(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                if x.shape[1] > MAX_COLUMNS:
                    raise ValueError(f"more than {MAX_COLUMNS} columns")
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    return rows.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def gramian_product(rows: DataFrame, column: str, v: np.ndarray) -> np.ndarray:
    """The Gramian times ``v`` without making it; a vector of the matrix's width comes back from each task."""

    def partial(batches):
        total = np.zeros(len(v))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                total += x.T @ (x @ v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(total)], ["i", "value"])

    found = rows.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(v))
    for r in found:
        out[r["i"]] = r["value"]
    return out


def full(upper: DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for r in upper.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def local_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, descending, and their vectors as columns."""
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not np.allclose(a, a.T):
        raise ValueError("the matrix is not symmetric")
    values, vectors = np.linalg.eigh(a)
    return values[::-1], vectors[:, ::-1]


def lanczos(mul: Callable[[np.ndarray], np.ndarray], n: int, k: int, tolerance: float = 1e-10, max_iterations: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` eigenvalues of largest magnitude, descending, of the symmetric operator ``mul``."""
    q = np.random.default_rng(seed).normal(size=n)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    while True:
        w = mul(basis[-1])
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        beta = float(np.linalg.norm(w))
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
        order = np.argsort(-np.abs(values))[:k]
        settled = len(alphas) >= k and np.all(np.abs(beta * vectors[-1, order]) <= tolerance * max(1e-300, np.abs(values).max()))
        if settled or beta <= 1e-13 * max(1.0, np.abs(values).max()) or len(alphas) >= min(n, max_iterations):
            order = order[np.argsort(-values[order])]
            return values[order], np.array(basis).T @ vectors[:, order]
        betas.append(beta)
        basis.append(w / beta)


def svd(rows: DataFrame, column: str, k: int, r_cond: float = 1e-9, compute_u: bool = False, mode: str = "auto", max_iterations: int | None = None) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The ``k`` largest singular values, the right vectors as columns and, if asked for, rows with ``u``.

    ``auto``: the Gramian on the driver for less than 100 columns or ``k`` above
    half of them, else Lanczos over distributed products. Values below
    ``r_cond`` times the largest are dropped.
    """
    n = rows.where(F.col(column).isNotNull()).agg(F.max(F.size(column))).first()[0] or 0
    if not 0 < k <= n:
        raise ValueError(f"k is {k}; the matrix has {n} columns")
    if mode == "local" or mode == "auto" and (n < 100 or k > n / 2):
        values, vectors = local_eigen(full(gramian(rows, column), n))
    else:
        values, vectors = lanczos(lambda v: gramian_product(rows, column, v), n, k, max_iterations=max_iterations or max(300, 3 * k))
    sigma = np.sqrt(np.maximum(values[:k], 0))
    kept = int(np.count_nonzero(sigma > r_cond * sigma[0])) if sigma[0] > 0 else 0
    sigma, v = sigma[:kept], vectors[:, :kept]
    u = None
    if compute_u:
        dot = lambda c: F.aggregate(F.zip_with(column, F.array(*map(F.lit, map(float, v[:, c] / sigma[c]))), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
        u = rows.withColumn("u", F.array(*(dot(c) for c in range(kept))))
    return sigma, v, u


def sliding(df: DataFrame, value: str, position: str, size: int) -> DataFrame:
    """(position, window): every complete window of ``size`` values in the order of ``position``, a dense unique number.

    Each row is sent to the windows it belongs to, so no task needs all rows.
    """
    at = F.explode(F.sequence(F.col(position) - (size - 1), F.col(position))).alias("start")
    sent = df.select(F.col(position).alias("p"), F.col(value).alias("x"), at)
    windows = sent.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("w")).where(F.size("w") == size)
    return windows.select(F.col("start").alias("position"), F.col("w.x").alias("window"))


def tree_aggregate(df: DataFrame, partial: Callable[[], dict[str, Column]], combine: Callable[[], dict[str, Column]], scale: int = 32) -> DataFrame:
    """Aggregate in two levels: within ``scale`` groups of partitions, then over those."""
    first = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(scale)).alias("__group")).agg(*(c.alias(n) for n, c in partial().items()))
    return first.agg(*(c.alias(n) for n, c in combine().items()))
