"""Embedding whitening: vectors in the basis of their principal components, each scaled to unit variance.

Method: a pivoted Cholesky factor of the centred scatter, then one-sided Jacobi rotations directly on the
columns of that triangular factor.  The rotated columns are orthogonal; their squared norms are the
eigenvalues and the normalised columns the components.

Entries become integers first, so counts and sums are exact on any partitioning.  Vectors are centred on
the whole number next to the mean before they are multiplied; the rest of the mean is taken off the scatter
afterwards in whole numbers.  Only tables of the dimension's square reach the driver: 64 x 64 numbers here,
whatever the number of rows.  The fit list (each distinct vector once) is made by partial aggregation, so a
vector that a third of all rows share is one row per task.

Defined cases: vectors that are null or hold a null, NaN or infinite entry, or one beyond +-2**31 / scale,
take no part; of vectors of several lengths only the most frequent length takes part (ties: the longer),
empty vectors never; repeated rows and null ids give rows each for itself; components whose eigenvalue is
zero to double precision are not returned (a single distinct vector returns no rows); an empty table gives an
empty result; a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import keep, python_ready

OFFSET = 1_000_000
ROWS = 4096
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, a column for each pivot (the largest diagonal left), rows in the order of ``a``."""
    d = len(a)
    out, left, open_ = np.zeros((d, d)), a.diagonal().copy(), np.ones(d, bool)
    floor = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= floor:
            return out[:, :k]
        out[open_, k] = (a[open_, p] - out[open_, :k] @ out[p, :k]) / np.sqrt(left[p])
        left -= out[:, k] ** 2
        left[p], open_[p] = -np.inf, False
    return out


def jacobi_columns(m: np.ndarray) -> np.ndarray:
    """``m`` with its columns rotated in pairs until all are orthogonal, in order of falling norm."""
    m = m.copy()
    k = m.shape[1]
    order = np.arange(k + k % 2)
    for _ in range(60):
        turned = False
        for _ in range(len(order) - 1):  # every pair once: a round deals the columns into disjoint pairs
            p, q = order[:len(order) // 2], order[len(order) // 2:][::-1]
            real = (p < k) & (q < k)
            p, q = p[real], q[real]
            x, y = m[:, p], m[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if do.any():
                turned = True
                p, q, x, y, a, b, c = p[do], q[do], x[:, do], y[:, do], a[do], b[do], c[do]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                m[:, p], m[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    return m[:, np.argsort(-(m * m).sum(0), kind="stable")]


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the entry of largest size is positive)."""
    m = jacobi_columns(pivoted_cholesky(scatter))
    values = (m * m).sum(0)
    some = values > len(scatter) * np.finfo(float).eps * values.max(initial=0.0)
    m, values = m[:, some], values[some]
    vectors = m / np.sqrt(values)
    if len(values):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values, vectors


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 31) / scale), F.lit(False)))
    v = vectors.where(F.col("embedding").isNotNull() & ok & (F.size("embedding") > 0))
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * scale) + OFFSET).alias("x"))


def summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all rows of the ``width`` numbers that ``make`` gives for a batch of vectors."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(width)
        for b in batches:
            for a in range(0, len(b), ROWS):
                total += make(b.column(0).slice(a, ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["at", "v"])

    got = rows.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(width)
    out[got["at"].to_numpy(int)] = got["v"]
    return out


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (vectors: vec_id, embedding)."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = whole_vectors(vectors, scale)
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    fit = keep(rows.select("x").distinct(), "fit")
    stats = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    n, total = stats["n"], [int(stats[f"s{i}"]) for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]

    def products(col):
        y = (_matrix(col, d) - centre).astype(float)
        return (y.T @ y).ravel()

    gram = summed(fit, products, d * d).reshape(d, d)
    # n * scatter in whole numbers, then the covariance: what is left of the mean goes here.
    cov = np.array([[(n * int(gram[i, j]) - rest[i] * rest[j]) / n ** 2 for j in range(d)] for i in range(d)])
    values, vecs = principal(cov)
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], OUT)
    explained, project = values[:k] / cov.trace(), vecs[:, :k] / np.sqrt(values[:k])
    left = np.array([r / n for r in rest])

    def projected(col):
        return (_matrix(col, d) - centre - left) @ project

    def moments(col):
        w = projected(col)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    m = summed(fit, moments, k + k * k) / n
    error = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())
    rest_wrapped = np.array([r & (1 << 64) - 1 for r in rest], np.uint64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for a in range(0, len(b), ROWS):
                ids, col = b.column(0).slice(a, ROWS), b.column(1).slice(a, ROWS)
                x = _matrix(col, d) - centre
                z = x.astype(np.uint64) * np.uint64(n & (1 << 64) - 1) - rest_wrapped  # n x - S, modulo 2**64
                exact = (z * z).sum(1, dtype=np.uint64).view(np.int64)
                size = (((x - left) * n) ** 2).sum(1)
                far = size > 9.2e18  # near or beyond the end of a long: whole numbers of any size
                deviation = exact.tolist()
                for i in np.flatnonzero(far).tolist():
                    v = sum((n * p - r) ** 2 for p, r in zip(x[i].tolist(), rest))
                    deviation[i] = v if v < 1 << 63 else None
                w = projected(col)
                rows_ = len(ids)
                at = np.repeat(np.arange(rows_), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(len(at), n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(len(at), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
