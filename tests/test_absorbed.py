"""Absorbed widest factor against dense least squares with every dummy."""

import numpy as np
import pandas as pd
import pytest

from panelspark.operators.absorbed import absorbed_cluster, absorbed_two_way
from panelspark.operators.regression import Model

MODEL = Model("y", ("x1", "x2"), ("date", "kind"))


def data(rows=20_000, dates=1200, clusters=5000, seed=4):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "date": rng.integers(0, dates, rows), "kind": rng.choice(["a", "b", "c"], rows),
        "x1": rng.normal(size=rows), "x2": rng.normal(size=rows),
        "g": rng.integers(0, clusters, rows), "h": rng.integers(0, 40, rows),
    })
    frame["y"] = 1.5 * frame.x1 - 0.5 * frame.x2 + frame.date * 0.01 + (frame.kind == "b") + rng.normal(size=rows)
    return frame


def dense(frame, keys, signs):
    dates, kinds = sorted(frame.date.unique()), sorted(frame.kind.unique())
    names = ["Intercept"] + [f"C(date)[T.{d}]" for d in dates[1:]] + [f"C(kind)[T.{k}]" for k in kinds[1:]] + ["x1", "x2"]
    x = np.zeros((len(frame), len(names)))
    x[:, 0] = 1
    codes = np.searchsorted(dates, frame.date)
    hit = codes > 0
    x[np.flatnonzero(hit), codes[hit]] = 1
    for j, k in enumerate(kinds[1:]):
        x[:, len(dates) + j] = frame.kind == k
    x[:, -2], x[:, -1] = frame.x1, frame.x2
    y = frame.y.to_numpy()
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    cov = np.zeros((k, k))
    for key, sign in zip(keys, signs):
        groups, index = np.unique(frame[key].astype(str).agg("|".join, axis=1), return_inverse=True)
        u = np.zeros((len(groups), k))
        np.add.at(u, index, x * e[:, None])
        cov += sign * len(groups) / (len(groups) - 1) * (n - 1) / (n - k) * bread @ (u.T @ u) @ bread
    return dict(zip(names, zip(beta, np.sqrt(np.diag(cov)))))


def compare(got, expected):
    assert len(got) == len(expected)
    for row in got.itertuples():
        b, se = expected[row.term]
        assert row.coefficient == pytest.approx(b, rel=1e-8, abs=1e-10)
        assert row.std_error == pytest.approx(se, rel=1e-8)


def test_one_way_1200_dates_5000_clusters(spark):
    frame = data()
    got = absorbed_cluster(spark.createDataFrame(frame), MODEL, "g").toPandas()
    assert got.term.iloc[0] == "Intercept" and got.p_value.notna().all()
    compare(got, dense(frame, [["g"]], [1.0]))


def test_two_way(spark):
    frame = data(rows=6000, dates=300, clusters=500, seed=7)
    got = absorbed_two_way(spark.createDataFrame(frame), MODEL, "g", "h").toPandas()
    compare(got, dense(frame, [["g"], ["h"], ["g", "h"]], [1.0, 1.0, -1.0]))
