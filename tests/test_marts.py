import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.operators import aggregates as A
from panelspark.plans import marts

T0 = dt.datetime(2024, 6, 1)


def hour(n):
    return T0 + dt.timedelta(hours=n)


def long_rows(spark, rows):
    return spark.createDataFrame(rows, "region string, metric string, event_time_utc timestamp, value double")


def test_wind_source_is_chosen_per_zone(spark):
    rows = []
    for region in ("A", "B", "C"):
        rows += [(region, m, hour(0), 10.0) for m in K.COMMON_METRICS]
    rows += [("A", K.WIND, hour(1), 5.0), ("A", K.WIND_ONSHORE, hour(0), 4.0), ("B", K.WIND_ONSHORE, hour(0), 3.0)]
    panel = {(r.region, r.event_time_utc): r for r in marts.multi_zone_panel(long_rows(spark, rows), ["A", "B", "C"], "b").collect()}
    # A has the primary metric somewhere, so its onshore value is not used
    assert panel[("A", hour(0))].wind_generation_mw is None
    assert panel[("A", hour(0))].wind_source_metric == K.WIND
    assert panel[("B", hour(0))].wind_generation_mw == 3.0
    assert panel[("C", hour(0))].wind_source_metric is None
    assert panel[("B", hour(0))].renewable_share == pytest.approx(1.3)


def test_energy_research_requires_metrics(spark):
    rows = [("A", m, hour(0), 0.0) for m in K.COMMON_METRICS]
    with pytest.raises(ValueError, match=K.WIND):
        marts.energy_research(long_rows(spark, rows), "A", "b", "now")
    full = long_rows(spark, rows + [("A", K.WIND, hour(0), 1.0)])
    row = marts.energy_research(full, "A", "b", "now").first()
    assert row.renewable_share is None and row.load_forecast_error_pct is None
    assert row.negative_price_flag is False


def weather(spark, rows):
    names = ", ".join(f"{a} double" for _, a in K.WEATHER_VARIABLES.values())
    return spark.createDataFrame(rows, f"location string, event_time_utc timestamp, {names}, batch_id string")


def forecast(spark, rows):
    names = ", ".join(f"{f} double" for f, _ in K.WEATHER_VARIABLES.values())
    return spark.createDataFrame(
        rows, f"location string, forecast_run_utc timestamp, valid_time_utc timestamp, forecast_horizon_hours double, {names}"
    )


def test_forecast_error_keeps_vintages_and_unmatched(spark):
    actual = weather(spark, [("paris", hour(1), 10.0, 1.0, None, 0.0, "w1")])
    rows = [
        ("paris", hour(0), hour(1), 1.0, 12.0, 0.5, 5.0, 0.0),
        ("paris", hour(-12), hour(1), 13.0, 9.0, 2.0, 5.0, 1.0),
        ("paris", hour(0), hour(30), 30.0, 9.0, 2.0, 5.0, 1.0),
        ("vienna", hour(0), hour(1), None, 9.0, 2.0, 5.0, 1.0),
    ]
    mart = marts.forecast_error_mart(forecast(spark, rows), actual)
    got = {(r.location, r.forecast_run_utc, r.valid_time_utc): r for r in mart.collect()}
    assert len(got) == 4
    assert got[("paris", hour(0), hour(1))].temperature_error == 2.0
    assert got[("paris", hour(-12), hour(1))].temperature_error == -1.0
    assert got[("paris", hour(0), hour(1))].shortwave_radiation_error is None
    assert got[("paris", hour(0), hour(30))].actual_match_flag is False
    assert got[("paris", hour(0), hour(30))].horizon_bin == "24-47h"
    assert got[("vienna", hour(0), hour(1))].horizon_bin == "unknown"
    metrics = {r.variable: r for r in A.error_metrics(mart).collect()}
    assert (metrics["temperature"].n, metrics["temperature"].mae) == (2, 1.5)
    assert metrics["temperature"].rmse == pytest.approx(2.5**0.5)
    assert (metrics["shortwave_radiation"].n, metrics["shortwave_radiation"].mae) == (0, None)
    by_bin = A.error_metrics(mart, ["horizon_bin"]).where("horizon_bin = 'unknown'")
    assert by_bin.count() == 4
    with pytest.raises(ValueError, match="duplicate"):
        marts.forecast_error_mart(forecast(spark, rows + rows[:1]), actual)


def errors(spark, rows):
    names = ", ".join(f"{c} double" for c in K.WEATHER_ERRORS)
    return spark.createDataFrame(
        [(*r[:4], *([r[4]] * 8)) for r in rows],
        f"location string, forecast_run_utc timestamp, valid_time_utc timestamp, forecast_horizon_hours double, {names}",
    )


def market(spark, rows):
    return spark.createDataFrame(rows, "bzn string, event_time_utc timestamp, metric string, value double")


def test_impact_marts(spark):
    quarter = dt.timedelta(minutes=15)
    observations = market(spark, [
        ("FR", hour(1), "price_day_ahead", -4.0), ("FR", hour(1) + quarter, "price_day_ahead", 2.0),
        ("FR", hour(1), "forecast_load", 9.0), ("FR", hour(1), "actual_load", 7.0),
        ("FR", hour(1), "ignored_metric", 7.0), ("AT", hour(1), "price_day_ahead", 50.0),
    ])
    vintages = errors(spark, [
        ("paris", hour(0), hour(1), 1.0, 1.0), ("paris", hour(0), hour(2), 2.0, 1.0),
        ("vienna", hour(0), hour(1), 1.0, 3.0), ("vienna", hour(3), hour(1), -2.0, 3.0),
    ])
    mapping = spark.createDataFrame([("FR", "paris"), ("AT", "vienna")], "bzn string, location string")
    panel = {
        (r.bzn, r.forecast_run_utc, r.valid_time_utc): r
        for r in marts.multi_zone_forecast_impact(observations, vintages, mapping).collect()
    }
    fr = panel[("FR", hour(0), hour(1))]
    assert (fr.price_day_ahead, fr.negative_price_flag, fr.load_forecast_error_mw) == (-1.0, 1, 2.0)
    assert fr.weather_location_complete and fr.actual_wind_offshore is None
    assert panel[("FR", hour(0), hour(2))].market_match_flag is False
    assert panel[("FR", hour(0), hour(2))].negative_price_flag is None
    assert panel[("AT", hour(3), hour(1))].forecast_availability_proxy is False
    single = marts.forecast_impact(observations, vintages, "FR").where(F.col("forecast_run_utc") == hour(0))
    averaged = {r.valid_time_utc: r for r in single.collect()}
    assert averaged[hour(1)].temperature_error == 2.0 and averaged[hour(1)].weather_location_complete
    assert averaged[hour(2)].weather_location_complete is False
    unmapped = market(spark, [("CH", hour(1), "price_day_ahead", 1.0)])
    with pytest.raises(ValueError, match="no mapping"):
        marts.multi_zone_forecast_impact(unmapped, vintages, mapping)


def test_panel_size_of_thirty_runs(spark):
    runs = spark.range(30).selectExpr("timestamp_seconds(1717200000 + id * 43200) AS forecast_run_utc")
    grid = runs.selectExpr("forecast_run_utc", "explode(sequence(0, 239)) AS h").selectExpr(
        "forecast_run_utc", "timestampadd(HOUR, h, forecast_run_utc) AS valid_time_utc",
        "CAST(h AS DOUBLE) AS forecast_horizon_hours", "explode(array('frankfurt', 'paris', 'vienna')) AS location",
        *[f"CAST(h AS DOUBLE) AS {c}" for c in K.WEATHER_ERRORS],
    )
    observations = grid.selectExpr(
        "CASE location WHEN 'paris' THEN 'FR' WHEN 'vienna' THEN 'AT' ELSE 'DE-LU' END AS bzn",
        "valid_time_utc AS event_time_utc", "'price_day_ahead' AS metric", "1.0 AS value",
    ).distinct()
    mapping = spark.createDataFrame(list(K.ZONE_LOCATION.items()), "bzn string, location string")
    panel = marts.multi_zone_forecast_impact(observations, grid, mapping)
    counts = A.outcome_table(panel.where("market_match_flag"), ["bzn"], ["mean_price"],
                             {"valid_hours": "valid_time_utc", "forecast_runs": "forecast_run_utc"})
    assert sorted((r.bzn, r.rows, r.valid_hours, r.forecast_runs) for r in counts.collect()) == [
        ("AT", 7200, 588, 30), ("DE-LU", 7200, 588, 30), ("FR", 7200, 588, 30)
    ]
    # eleven warm-up hours per zone have no volatility
    assert panel.where("price_volatility_24h IS NULL").count() == 33


# Published metrics per location and overall (temperature).
BY_LOCATION = [(240, -1.2120833333333332, 1.9595833333333335, 2.5512986889033593),
               (240, -1.4470833333333333, 2.097083333333333, 2.7501136340158747)]
OVERALL = (480, -1.3295833333333333, 2.0283333333333333, 2.6525695089855796)


def test_published_location_metrics_combine():
    n, bias, mae, rmse = (np.array(c) for c in zip(*BY_LOCATION))
    total = n.sum()
    combined = (total, (n * bias).sum() / total, (n * mae).sum() / total, np.sqrt((n * rmse**2).sum() / total))
    assert combined == pytest.approx(OVERALL, rel=1e-12)


# Published precipitation MAE per 24-hour bin and its trend.
PRECIPITATION_MAE = [0.27391304347826084, 0.0625, 0.0, 0.004166666666666667, 0.11833333333333335,
                     0.018541666666666668, 0.0, 0.48666666666666664, 0.5114583333333332, 0.08333333333333333]


def test_published_trend(spark):
    rows = [("precipitation", i * 24, mae) for i, mae in enumerate(PRECIPITATION_MAE)] + [("wind_speed", 0, 1.0)]
    trend = A.horizon_trend(
        spark.createDataFrame(rows, "variable string, horizon_bin_start_hours long, mae double")
    ).collect()
    assert len(trend) == 1 and trend[0].horizon_bins == 10
    assert trend[0].mae_slope_per_hour == pytest.approx(0.000946599143610013, rel=1e-9)
    assert trend[0].horizon_mae_correlation == pytest.approx(0.3460104484063148, rel=1e-9)
    assert trend[0].interpretation == "descriptive upward MAE trend"


def test_condition_summary_keeps_empty_conditions(spark):
    rows = [(1.0, False, False, 0.5, True, False, False), (3.0, True, False, None, True, True, False)]
    names = "price_day_ahead_eur_mwh double, negative_price_flag boolean, price_spike_flag boolean, " \
            "renewable_share double, rain_flag boolean, high_wind_flag boolean, cold_weather_flag boolean"
    got = {r.condition: r for r in A.condition_summary(spark.createDataFrame(rows, names)).collect()}
    assert got["all"].rows == 2 and got["all"].median_price_eur_mwh == 2.0
    assert got["cold"].rows == 0 and got["cold"].mean_price_eur_mwh is None
    assert got["high_wind"].negative_price_rate == 1.0 and got["no_rain"].rows == 0


def test_box_plot_figures_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.gamma(2, 3, 200), [500.0]])
    names = ", ".join(f"{v}_absolute_error double" for v in K.WEATHER_VARIABLES)
    frame = spark.createDataFrame([(0, float(v), None, None, None) for v in values], f"horizon_bin_start_hours long, {names}")
    row = A.error_distribution(frame).collect()[0]
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    assert (row.q1, row.median, row.q3) == pytest.approx((q1, q2, q3))
    assert (row.whisker_low, row.whisker_high) == pytest.approx((inside.min(), inside.max()))
