"""Embedding whitening from exact integer cross-products of bit-sliced columns.

Every finite entry c becomes the integer x = floor(64 c) + 1,000,000. The fit
list holds each distinct x vector once (a shuffle whose partial aggregation
folds a hot vector before it moves). Its cross-products are computed exactly in
the tasks: each task shifts its rows by the per-dimension minimum of the task,
packs bit plane p of dimension i over 64 rows into one word, and obtains
sum_r y_ri * y_rj as sum_{p,q} 2^(p+q) * popcount(W[i,p] & W[j,q]). The shift is
undone with Python integers, so each task reports exact sums of x and x x^T;
Spark adds them as decimal(38,0). The driver receives d(d+1)/2 + d + 1 numbers
whatever the row count, centres as integers (n * G - S S^T) and only then
converts to floating point for ``eigh``.

Defined cases: a null vector, or one holding a null, NaN or infinite entry, or
an entry whose x does not fit a long, drops its row. Rows whose length differs
from the longest remaining length are dropped too (they do not live in the same
space); an empty table or a fit list of one vector gives no components and no
rows. Components whose eigenvalue is not above d * 2^-52 times the largest are
numerically zero: they cannot be whitened and get no rows. Repeated rows and
repeated vec_ids each get their own rows; copies of a vector count once in the
fit. Extra columns of the input are ignored. The sign of a component makes its
entry of largest magnitude positive (first such entry on ties).
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
_ROWS_PER_STEP = 16384
_MOMENT_SCHEMA = "i int, j int, total decimal(38,0)"


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that can be whitened."""
    entries = F.col(vector)
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**56))
    valid = embeddings.where(entries.isNotNull() & finite).select(
        "vec_id",
        F.transform(entries, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long")).alias("x"),
    )
    longest = valid.agg(F.max(F.size("x")).alias("d"))
    return valid.join(longest.hint("broadcast"), F.size("x") == F.col("d")).drop("d")


def _plane_words(y: np.ndarray, bits: int) -> np.ndarray:
    """Words of bit planes: [dimension * bits + plane, word] holds 64 rows' bits."""
    rows, dims = y.shape
    padded = (rows + 63) // 64 * 64
    planes = np.zeros((dims * bits, padded), dtype=np.uint8)
    for plane in range(bits):
        planes[plane::bits, :rows] = ((y >> plane) & 1).T
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


def _shifted_products(y: np.ndarray) -> np.ndarray:
    """sum_r y_ri y_rj as Python integers, by weighted AND-popcounts of bit planes."""
    dims = y.shape[1]
    bits = max(int(y.max()).bit_length(), 1) if y.size else 1
    words = _plane_words(y, bits)
    counts = np.zeros((dims * bits, dims * bits), dtype=np.int64)
    for first in range(0, words.shape[1], _ROWS_PER_STEP // 64):
        block = words[:, first : first + _ROWS_PER_STEP // 64]
        for a in range(dims * bits):
            counts[a, a:] += np.bitwise_count(block[a] & block[a:]).sum(axis=1, dtype=np.int64)
    products = np.empty((dims, dims), dtype=object)
    weights = [[1 << (p + q) for q in range(bits)] for p in range(bits)]
    for i in range(dims):
        for j in range(i, dims):
            total = 0
            for p in range(bits):
                for q in range(bits):
                    a, b = i * bits + p, j * bits + q
                    count = int(counts[a, b] if a <= b else counts[b, a])
                    if count:
                        total += weights[p][q] * count
            products[i, j] = total
    return products


def _task_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact count, sums and upper-triangle cross-products of one task's vectors."""
    frames = [np.array(batch["x"].tolist(), dtype=np.int64) for batch in batches if len(batch)]
    frames = [f for f in frames if f.size]
    if not frames:
        return
    x = np.concatenate(frames)
    rows, dims = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    products = _shifted_products(y)
    shift = [int(v) for v in low]
    sums = [0] * dims
    for first in range(0, rows, 1 << 16):
        sums = [a + int(b) for a, b in zip(sums, y[first : first + (1 << 16)].sum(axis=0, dtype=object))]
    out_i, out_j, out_total = [-1], [-1], [rows]
    for i in range(dims):
        out_i.append(i), out_j.append(-1), out_total.append(sums[i] + rows * shift[i])
        for j in range(i, dims):
            # sum (y_i + m_i)(y_j + m_j) = sum y_i y_j + m_j T_i + m_i T_j + R m_i m_j
            exact = products[i, j] + shift[j] * sums[i] + shift[i] * sums[j] + rows * shift[i] * shift[j]
            out_i.append(i), out_j.append(j), out_total.append(exact)
    yield pd.DataFrame({"i": out_i, "j": out_j, "total": [decimal.Decimal(v) for v in out_total]})


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct x vector once."""
    return vectors.select("x").distinct()


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and G = sum x x^T of the fit list, exact; d(d+1)/2 + d + 1 values reach the driver."""
    parts = fit.mapInPandas(_task_moments, _MOMENT_SCHEMA)
    summed = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    n, sums, cross = 0, {}, {}
    for row in summed:
        value = int(row["total"])
        if row["i"] < 0:
            n = value
        elif row["j"] < 0:
            sums[row["i"]] = value
        else:
            cross[row["i"], row["j"]] = value
    dims = len(sums)
    s = [sums[i] for i in range(dims)]
    g = [[cross[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]
    return n, s, g


def components(n: int, s: list[int], g: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues e (falling) and unit eigenvectors (rows) of V, and trace(V)."""
    dims = len(s)
    if n < 2 or dims == 0:
        return np.zeros(0), np.zeros((0, dims)), 0.0
    centred = [[n * g[i][j] - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    scale = float(n) * float(n)
    matrix = np.array([[float(v) for v in row] for row in centred]) / scale
    trace = sum(centred[i][i] for i in range(dims)) / scale
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order].T
    keep = values > max(values[0], 0.0) * dims * 2.0**-52
    values, vectors = values[keep][:COMPONENTS], vectors[keep][:COMPONENTS]
    for k in range(len(vectors)):
        if vectors[k][int(np.argmax(np.abs(vectors[k])))] < 0:
            vectors[k] = -vectors[k]
    return values, vectors, float(trace)


def _projector(n: int, s: list[int], values: np.ndarray, vectors: np.ndarray):
    """Task functions: whitened values of each row, and partial sums of their products."""
    from fractions import Fraction

    dims = len(s)
    base = s[0] // n if dims else 0
    # centre against an integer near the mean, so doubles never carry the 10^6 offset
    centre = np.array([float(Fraction(s[i], n) - base) for i in range(dims)])
    scale = 1.0 / np.sqrt(values)
    k = len(values)

    def whitened(batch: pd.DataFrame) -> np.ndarray:
        x = np.array(batch["x"].tolist(), dtype=np.int64).reshape(len(batch), dims)
        return (((x - base).astype(np.float64) - centre) @ vectors.T) * scale

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({
                    "vec_id": np.repeat(batch["vec_id"].to_numpy(), k),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)),
                    "deviation": np.repeat(batch["deviation"].to_numpy(), k),
                    "whitened": whitened(batch).reshape(-1),
                })

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = whitened(batch)
                total += w.sum(axis=0)
                cross += w.T @ w
        rows = [(a + 1, b + 1, float(cross[a, b])) for a in range(k) for b in range(a, k)]
        rows += [(a + 1, 0, float(total[a])) for a in range(k)]
        yield pd.DataFrame(rows, columns=["k", "l", "total"]).astype({"k": "int32", "l": "int32"})

    return project, products


def identity_error(fit: DataFrame, products, n: int) -> float:
    """Largest |cov(whitened) - I| over the fit list; k(k+3)/2 sums reach the driver."""
    sums = fit.mapInPandas(products, "k int, l int, total double").groupBy("k", "l").agg(F.sum("total").alias("total"))
    found = {(r["k"], r["l"]): r["total"] for r in sums.collect()}
    worst = 0.0
    for (a, b), total in found.items():
        if b:
            cov = total / n - (found[a, 0] / n) * (found[b, 0] / n)
            worst = max(worst, abs(cov - (1.0 if a == b else 0.0)))
    return worst


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = written(integer_vectors(embeddings, vector), "whiten-vectors")
    fit = written(fit_list(vectors), "whiten-fit")
    n, s, g = moments(fit)
    values, basis, trace = components(n, s, g)
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], RESULT)
    project, products = _projector(n, s, values, basis)
    error = identity_error(fit, products, n)
    sums = F.array(*[F.lit(v).cast("decimal(38,0)") for v in s])
    spread = F.aggregate(
        F.zip_with(F.col("x"), sums, lambda a, b: F.lit(n).cast("decimal(38,0)") * a.cast("decimal(38,0)") - b),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, v: acc + v * v,
    )
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    rows = vectors.select("vec_id", spread.cast("long").alias("deviation"), "x")
    projected = rows.mapInPandas(project, "vec_id long, component int, deviation long, whitened double")
    return projected.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
