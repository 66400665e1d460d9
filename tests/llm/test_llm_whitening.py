"""Whitening against dense numpy algebra on the same integer vectors."""

import math

import numpy as np
import pytest

from panelspark.llm import whitening
from panelspark.llm.queries import op11_bit_sliced_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in kept if len(v) == d]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=np.float64)
    n = len(fit)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return kept, fit, values[order], vectors[:, order].T, np.trace(cov)


def test_against_dense_algebra(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (120, 6)) @ rng.normal(0, 1, (6, 6))
    rows = [(i, [float(c) for c in base[i]]) for i in range(120)]
    rows += [(500, rows[0][1]), (7, rows[7][1]), (501, None), (502, [0.1, None, 0.0, 0.0, 0.0, 0.0]),
             (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (505, [0.1, 0.2]), (506, [1e30] * 6)]
    df = spark.createDataFrame(rows, SCHEMA.replace(", label int", "")).withColumn("x", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = whitening.whiten(df).toPandas()
    kept, fit, values, vectors, trace = brute(rows[:-1] + [(506, None)])
    assert got.n.iloc[0] == len(fit)
    assert sorted(got.vec_id.unique()) == sorted({i for i, _ in kept})
    assert len(got) == len(kept) * 6
    s = fit.sum(axis=0)
    by_id = {}
    for i, v in kept:
        by_id.setdefault(i, []).append(v)
    mean = fit.mean(axis=0)
    for _, row in got.iterrows():
        k = int(row.component) - 1
        assert row.explained == pytest.approx(values[k] / trace, rel=1e-6)
        options = [int(sum((len(fit) * c - t) ** 2 for c, t in zip(v, s))) for v in by_id[row.vec_id]]
        assert row.deviation in options
        projections = [abs((np.array(v) - mean) @ vectors[k] / math.sqrt(values[k])) for v in by_id[row.vec_id]]
        assert min(abs(abs(row.whitened) - p) for p in projections) < 1e-7
    assert got.identity_error.max() < 1e-9


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, None, 1)], SCHEMA)
    assert whitening.whiten(one).count() == 0


def test_popcount_products_are_exact():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2**9, (1000, 5)).astype(np.uint64)
    exact = y.astype(object).T @ y.astype(object)
    got = whitening._shifted_products(y)
    for i in range(5):
        for j in range(i, 5):
            assert got[i, j] == exact[i, j]


def test_query_on_tables(spark):
    got = op11_bit_sliced_whitening(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert rows and max(r.component for r in rows) == 16
    assert max(r.identity_error for r in rows) < 1e-4
