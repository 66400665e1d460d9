"""A third of all rows share one key, value or bucket; results stay whole."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import windows as W
from panelspark.operators.guards import duplicate_key_count
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.regression import Model, fit_cluster, fit_hac
from panelspark.plans import marts

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(9)
    n = 30_000
    hot = rng.random(n) < 1 / 3
    frame = pd.DataFrame(
        {
            "bzn": np.where(hot, "HOT", rng.choice([f"z{i}" for i in range(50)], n)),
            "second": np.where(hot, rng.integers(0, 3600, n), rng.integers(0, 30 * 86400, n)),
            "value": np.where(rng.random(n) < 1 / 3, 7.0, rng.normal(50, 30, n)),
        }
    )
    frame["event_time_utc"] = START + pd.to_timedelta(frame.second, unit="s")
    return frame, spark.createDataFrame(frame)


def test_hourly_market_of_a_hot_zone(skewed):
    frame, sdf = skewed
    hourly = marts.market_hourly(sdf.withColumn("metric", F.lit("price_day_ahead"))).toPandas()
    want = frame.groupby(["bzn", frame.event_time_utc.dt.floor("h")]).value.mean()
    assert len(hourly) == len(want)
    got = hourly.set_index(["bzn", "valid_time_utc"]).price_day_ahead.sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.sort_index().to_numpy())


def test_quantiles_and_steps_of_a_hot_group(skewed):
    frame, sdf = skewed
    for row in exact_quantiles(sdf, ["bzn"], "value", [0.25, 0.5]).collect():
        own = frame.loc[frame.bzn == row.bzn, "value"]
        assert row.quantile == pytest.approx(own.quantile(row.probability), abs=1e-12)
    steps = {r.bzn: r.resolution_minutes for r in W.resolution_minutes(sdf, ["bzn"], "event_time_utc").collect()}
    for zone, own in frame.groupby("bzn"):
        seconds = own.event_time_utc.drop_duplicates().sort_values().diff().dropna().dt.total_seconds()
        assert steps[zone] == pytest.approx(seconds.median() / 60)


def test_duplicates_of_a_hot_key(skewed):
    frame, sdf = skewed
    got = duplicate_key_count(sdf, ["bzn", "event_time_utc"]).first().duplicate_key_count
    assert got == frame.duplicated(["bzn", "event_time_utc"]).sum()


def test_regressions_with_a_hot_cluster_and_leading_key(spark):
    rng = np.random.default_rng(4)
    n = 6000
    hot = rng.random(n) < 1 / 3
    frame = pd.DataFrame({"g": np.where(hot, 0, rng.integers(1, 200, n)), "row": np.arange(n)})
    frame["x"], frame["y"] = rng.normal(size=n), rng.normal(size=n)
    sdf = spark.createDataFrame(frame)
    x = np.column_stack([np.ones(n), frame.x])
    beta = np.linalg.lstsq(x, frame.y, rcond=None)[0]
    u = x * (frame.y.to_numpy() - x @ beta)[:, None]
    bread = np.linalg.inv(x.T @ x)
    score = pd.DataFrame(u).groupby(frame.g).sum().to_numpy()
    groups = len(score)
    v = groups / (groups - 1) * (n - 1) / (n - 2) * bread @ score.T @ score @ bread
    fit = fit_cluster(sdf, Model("y", ("x",)), "g")
    np.testing.assert_allclose(fit.se, np.sqrt(np.diag(v)), rtol=1e-8)
    ordered = u[frame.sort_values(["g", "row"]).index.to_numpy()]
    meat = ordered.T @ ordered
    for lag in range(1, 6):
        gamma = ordered[lag:].T @ ordered[:-lag]
        meat += (1 - lag / 6) * (gamma + gamma.T)
    hac = fit_hac(sdf, Model("y", ("x",)), ["g", "row"], lags=5, chunk=500)
    np.testing.assert_allclose(hac.se, np.sqrt(np.diag(bread @ meat @ bread)), rtol=1e-8)
