import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import windows as W

START = dt.datetime(2024, 1, 1)


def hours(*numbers):
    return [START + dt.timedelta(hours=n) for n in numbers]


def test_price_dynamics_match_pandas(spark):
    rng = np.random.default_rng(1)
    frames = []
    for zone in ("A", "B"):
        kept = sorted(rng.choice(80, 60, replace=False))
        price = rng.normal(50, 20, 60)
        price[rng.random(60) < 0.2] = np.nan
        frames.append(pd.DataFrame({"bzn": zone, "valid_time_utc": hours(*map(int, kept)), "price_day_ahead": price}))
    frame = pd.concat(frames)
    spark_frame = spark.createDataFrame(frame).replace(float("nan"), None)
    got = W.price_dynamics(spark_frame).toPandas().sort_values(["bzn", "valid_time_utc"])
    for zone, own in frame.groupby("bzn"):
        mine = got[got.bzn == zone]
        np.testing.assert_allclose(mine.price_change_eur_mwh.astype(float), own.price_day_ahead.diff())
        np.testing.assert_allclose(
            mine.price_volatility_24h.astype(float), own.price_day_ahead.rolling(24, min_periods=12).std()
        )
    with pytest.raises(ValueError):
        W.price_dynamics(spark_frame, window=1)


def test_gaps_and_resolution_across_blocks(spark):
    minutes = [0, 15, 30, 30, 45, 60, 75, 60 * 30, 60 * 30 + 15]
    rows = [("x", START + dt.timedelta(minutes=m)) for m in minutes] + [("single", START), ("x", None)]
    frame = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    gaps = {r.k: r.missing_hour_intervals for r in W.missing_hour_intervals(frame, ["k"], "t").collect()}
    assert gaps == {"x": 1, "single": 0}
    steps = {r.k: r.resolution_minutes for r in W.resolution_minutes(frame, ["k"], "t").collect()}
    assert steps == {"x": 15.0, "single": None}


def test_zscore_rules_for_constant_columns(spark):
    rows = [("A", 1.0, 5.0), ("A", 3.0, 5.0), ("B", 2.0, 5.0), ("B", None, 5.0)]
    frame = spark.createDataFrame(rows, "bzn string, a double, c double")
    grouped = W.zscore_within_group(frame, ["bzn"], ["a", "c"]).collect()
    assert all(r.z_c is None for r in grouped)
    a = sorted(r.z_a for r in grouped if r.bzn == "A")
    assert a == pytest.approx([-(0.5**0.5), 0.5**0.5])
    overall = W.zscore_global(frame, ["a", "c"]).collect()
    assert all(r.z_c == 0.0 for r in overall)
    assert sum(r.z_a for r in overall if r.z_a is not None) == pytest.approx(0.0)


def test_regimes_count_null_as_low(spark):
    rows = [("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", None), ("B", 10.0)]
    frame = spark.createDataFrame(rows, "bzn string, s double")
    grouped = {(r.bzn, r.s): r.high_renewable_regime for r in W.regime_within_group(frame, ["bzn"], "s").collect()}
    assert grouped == {("A", 1.0): 0, ("A", 2.0): 1, ("A", 3.0): 1, ("B", None): 0, ("B", 10.0): 1}
    overall = {(r.bzn, r.s): r.high_renewable_regime for r in W.regime_global(frame, "s").collect()}
    assert overall == {("A", 1.0): 0, ("A", 2.0): 0, ("A", 3.0): 1, ("B", None): 0, ("B", 10.0): 1}
    empty = spark.createDataFrame([("A", None)], "bzn string, s double")
    assert W.regime_global(empty, "s").first().high_renewable_regime == 0
