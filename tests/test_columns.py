import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as C


def one(spark, schema, rows, **columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_numbers_and_times_are_coerced(spark):
    rows = [("1.5",), ("n/a",), ("NaN",), (None,), ("",)]
    assert one(spark, "v string", rows, v=C.to_double("v")) == [(1.5,)] + [(None,)] * 4
    stamps = [("2024-06-01T00:00Z",), ("2024-06-01T01:00",), ("2024-06-01 02:00:00",), ("soon",)]
    hours = one(spark, "v string", stamps, v=F.hour(C.to_timestamp("v")))
    assert hours == [(0,), (1,), (2,), (None,)]
    assert one(spark, "v long", [(86400,)], v=C.epoch_to_timestamp("v").cast("string")) == [
        ("1970-01-02 00:00:00",)
    ]


def test_units_and_names(spark):
    rows = [("Wind_Profile_price",), ("day_ahead_PRICE",), ("load",)]
    assert one(spark, "m string", rows, u=C.unit_of_metric("m")) == [
        ("fraction",), ("EUR/MWh",), ("MW",)
    ]
    names = [("Hydro & Pumped--Storage ",), ("Renewable Share of load",)]
    assert one(spark, "m string", names, n=C.normalized_name("m", "actual_"), u=C.unit_of_power_series("m")) == [
        ("actual_hydro_and_pumped_storage", "MW"),
        ("actual_renewable_share_of_load", "pct"),
    ]


def test_horizon_bins_with_negative_and_null(spark):
    start = C.horizon_bin_start("h", 24)
    rows = one(
        spark, "h double", [(0.0,), (23.5,), (24.0,), (-0.5,), (None,)],
        s=start, label=C.horizon_bin_label(start, 24),
    )
    assert rows == [
        (0, "0-23h"), (0, "0-23h"), (24, "24-47h"), (-24, "-24--1h"), (None, "unknown")
    ]
    with pytest.raises(ValueError):
        C.horizon_bin_start("h", 0)


def test_horizon_is_fractional(spark):
    run, valid = dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1, 1, 30)
    for kind in ("timestamp", "timestamp_ntz"):
        assert one(spark, f"r {kind}, v {kind}", [(run, valid)], h=C.horizon_hours("r", "v")) == [(1.5,)]


def test_guarded_ratio_and_flags(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (None, 2.0), (1.0, None)]
    assert one(spark, "a double, b double", rows, r=C.guarded_ratio("a", "b")) == [
        (0.5,), (None,), (None,), (None,), (None,)
    ]
    prices = [(-1.0,), (0.0,), (100.0,), (None,)]
    assert one(
        spark, "p double", prices, neg=C.flag_below("p", 0.0), spike=C.flag_at_least("p", 100.0),
        cold=C.flag_below("p", 0.0, 99.0), rain=C.flag_above("p", 0.0, 0.0),
    ) == [
        (True, False, True, False), (False, False, False, False),
        (False, True, False, True), (False, False, False, False),
    ]


def test_error_conventions(spark):
    row = [(10.0, 12.0)]
    both = {
        "a": C.load_error("x", "y", "actual_minus_forecast"),
        "b": C.load_error("x", "y", "forecast_minus_actual"),
    }
    assert one(spark, "x double, y double", row, **both) == [(-2.0, 2.0)]
    with pytest.raises(ValueError):
        C.load_error("x", "y", "other")


def test_calendar_monday_is_zero(spark):
    fields = C.calendar_fields("t")
    row = one(spark, "t timestamp_ntz", [(dt.datetime(2024, 6, 3, 5),)], **fields)[0]
    assert row == (5, 0, False, 2024, 6, "2024-06-03")
    assert one(spark, "t timestamp_ntz", [(dt.datetime(2024, 6, 8),)], w=fields["is_weekend"]) == [(True,)]
