"""Distributed wild bootstrap against dense per-cluster algebra with the same signs."""

import numpy as np
import pandas as pd
import pytest
import xxhash

from panelspark.operators.bootstrap import counter_signs, distributed_bootstrap
from panelspark.operators.regression import Model

MODEL = Model("y", ("x1", "x2"), ("kind",))


def dense(frame, reps, seed, target):
    kinds = sorted(frame.kind.unique())
    x = np.column_stack([np.ones(len(frame))] + [(frame.kind == k).to_numpy(float) for k in kinds[1:]]
                        + [frame.x1, frame.x2])
    terms = ["Intercept"] + [f"C(kind)[T.{k}]" for k in kinds[1:]] + ["x1", "x2"]
    at = terms.index(target)
    y = frame.y.to_numpy()
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    kept = [i for i in range(x.shape[1]) if i != at]
    beta_r = np.zeros(x.shape[1])
    beta_r[kept] = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
    names = sorted(frame.g.astype(str).unique())
    keys = np.array([xxhash.xxh64_intdigest(n.encode(), seed=42) for n in names], dtype=np.uint64)
    index = pd.Index(names).get_indexer(frame.g.astype(str))
    w = counter_signs(seed, np.arange(reps), keys)
    fitted, resid = x @ beta_r, y - x @ beta_r
    t = []
    for r in range(reps):
        ystar = fitted + w[r, index] * resid
        b = bread @ x.T @ ystar
        e = ystar - x @ b
        u = np.zeros((len(names), x.shape[1]))
        np.add.at(u, index, x * e[:, None])
        t.append(b[at] / np.sqrt(((u @ bread[at]) ** 2).sum()))
    return np.array(t)


def test_equals_dense_replicates(spark):
    rng = np.random.default_rng(2)
    n = 4000
    frame = pd.DataFrame({"g": rng.integers(0, 300, n), "kind": rng.choice(["a", "b"], n),
                          "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    frame["y"] = 0.3 * frame.x1 + rng.normal(size=n) + 0.2 * rng.normal(size=300)[frame.g]
    records = distributed_bootstrap(spark.createDataFrame(frame), MODEL, "g", ["x1"], reps=199, seed=11, rep_block=64)
    t = dense(frame, 199, 11, "x1")
    record = records[0]
    assert record["clusters"] == 300 and record["repetitions"] == 199
    low, middle, high = np.quantile(t, [0.025, 0.5, 0.975])
    assert record["bootstrap_t_2_5pct"] == pytest.approx(low, rel=1e-9)
    assert record["bootstrap_t_97_5pct"] == pytest.approx(high, rel=1e-9)
    assert record["bootstrap_t_50pct"] == pytest.approx(middle, rel=1e-7, abs=1e-12)


def test_signs_are_balanced_and_pure():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    w = counter_signs(3, np.arange(200), keys)
    assert abs(w.mean()) < 0.01 and np.array_equal(w, counter_signs(3, np.arange(200), keys))


def test_hundred_thousand_clusters(spark):
    rng = np.random.default_rng(5)
    n = 200_000
    frame = pd.DataFrame({"g": rng.integers(0, 100_000, n), "kind": rng.choice(["a", "b"], n),
                          "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    frame["y"] = frame.x1 + rng.normal(size=n)
    record = distributed_bootstrap(spark.createDataFrame(frame), MODEL, "g", ["x2"], reps=99, seed=1)[0]
    assert record["clusters"] > 85_000 and 0 < record["wild_bootstrap_p_value"] <= 1
