"""End-to-end marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.plans.registered import scans
from panelspark.plans.registered.reshape import MAPPED_SQL, mapping_frame
from panelspark.plans.registered.scans import WIDE_VALUES
from panelspark.plans.registered.spec import query
from panelspark.session import materialize
from panelspark.sources import payloads


@query(
    "mart_silver_long",
    "region s, metric s, source_column s, event_time_utc t, event_time_local s, value d, unit s, year i, month i",
    f"""SELECT *, l_shipdate AS event_time_utc, concat_ws('-', l_orderkey, l_linenumber) AS event_time_local,
          year(l_shipdate) AS year, month(l_shipdate) AS month FROM ({MAPPED_SQL})""",
)
def mart_silver_long(spark, sf_dir):
    wide = X.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("utc_timestamp"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cet_cest_timestamp"),
        *WIDE_VALUES,
    )
    long = marts.silver_long(
        wide, mapping_frame(spark), "utc_timestamp", "cet_cest_timestamp", WIDE_VALUES, "b1",
        "2024-02-01T00:00:00+00:00",
    )
    return marts.with_valid_time(long)


_ENERGY = (
    "event_time_utc t, region s, load_actual_mw d, load_forecast_mw d, load_forecast_error_mw d, "
    "load_forecast_error_pct d, solar_generation_mw d, wind_generation_mw d, "
    "renewable_generation_mw d, renewable_share d, price_day_ahead_eur_mwh d, "
    "negative_price_flag b, price_spike_flag b, hour_utc i, day_of_week i, is_weekend b, year i, month i"
)


@query(
    "mart_energy_research",
    _ENERGY,
    "SELECT * FROM zone_panel WHERE region = 'DE_LU'",
    "zone_panel",
)
def mart_energy_research(spark, sf_dir):
    return X.energy_research(spark, sf_dir, check=True)


@query(
    "mart_multi_zone_panel",
    _ENERGY + ", wind_source_metric s",
    "SELECT * FROM zone_panel",
    "zone_panel",
)
def mart_multi_zone_panel(spark, sf_dir):
    return X.zone_panel(spark, sf_dir)


@query(
    "mart_energy_weather",
    _ENERGY
    + ", weather_location_count i, temperature_2m_c_mean d, precipitation_mm_max d, "
    "wind_speed_10m_kmh_max d, weather_join_status s, weather_complete_flag b, rain_flag b, "
    "heavy_rain_flag b, high_wind_flag b, cold_weather_flag b",
    "SELECT * FROM energy_weather",
    "energy_weather",
)
def mart_energy_weather(spark, sf_dir):
    return X.energy_weather(spark, sf_dir, check=True)


_ERRORS = ", ".join(f"{c} d" for c in K.WEATHER_ERRORS)


@query(
    "mart_forecast_error",
    "forecast_run_utc t, valid_time_utc t, forecast_horizon_hours d, horizon_bin s, "
    f"horizon_bin_start_hours i, location s, actual_match_flag b, {_ERRORS}",
    "SELECT * FROM errors",
    "errors",
)
def mart_forecast_error(spark, sf_dir):
    return X.forecast_errors(spark, sf_dir, check=True)


_IMPACT = (
    "forecast_run_utc t, valid_time_utc t, forecast_horizon_hours d, weather_location_count i, "
    "weather_location_complete b, market_match_flag b, forecast_availability_proxy b, bzn s, "
    f"{_ERRORS}, " + ", ".join(f"{c} d" for c in marts.MARKET_RESULT_COLUMNS)
)


@query(
    "mart_forecast_impact",
    _IMPACT,
    "SELECT v.*, weather_location_count >= 2 AS weather_location_complete,"
    " m.bzn IS NOT NULL AS market_match_flag, forecast_run_utc <= v.valid_time_utc AS forecast_availability_proxy,"
    " 'DE-LU' AS bzn, "
    + ", ".join(f"m.{c}" for c in marts.MARKET_RESULT_COLUMNS)
    + " FROM vintage_hours v LEFT JOIN (SELECT * FROM dynamics WHERE bzn = 'DE-LU') m"
    " ON m.valid_time_utc = v.valid_time_utc",
    "vintage_hours dynamics",
)
def mart_forecast_impact(spark, sf_dir):
    return X.zone_impact_panel(spark, sf_dir)


@query("mart_multi_zone_impact", _IMPACT + ", weather_location s", "SELECT * FROM impact", "impact")
def mart_multi_zone_impact(spark, sf_dir):
    """The flagship: every zone's market against its own weather vintages."""
    return X.impact_panel(spark, sf_dir)


_MARKET_SQL = f"""
WITH rows_ AS ({scans.PRICE_SQL} UNION ALL {scans.POWER_SQL} UNION ALL {scans.POWER_FORECAST_SQL})
SELECT r.*, s.resolution_minutes, year(event_time_utc) AS year, month(event_time_utc) AS month FROM rows_ r
LEFT JOIN (SELECT bzn, metric, median(step) / 60000000.0 AS resolution_minutes FROM (
    SELECT bzn, metric, epoch_us(event_time_utc) - lag(epoch_us(event_time_utc))
      OVER (PARTITION BY bzn, metric ORDER BY event_time_utc) AS step FROM rows_) GROUP BY ALL) s
USING (bzn, metric)"""


@query(
    "mart_market_silver",
    "bzn s, event_time_utc t, source_timestamp_s i, metric s, value d, unit s, series_type s, "
    "production_type s, source_endpoint s, resolution_minutes d, year i, month i",
    _MARKET_SQL,
    "hourly",
)
def mart_market_silver(spark, sf_dir):
    # the payloads are parsed once; the series steps read the typed rows
    rows = materialize(scans.market_silver_rows(spark, sf_dir), "market-rows")
    return marts.market_silver(rows)


@query(
    "mart_weather_silver",
    "location s, event_time_utc t, latitude d, longitude d, temperature_2m_c d, "
    "relative_humidity_2m_pct d, precipitation_mm d, wind_speed_10m_kmh d, "
    "shortwave_radiation_w_m2 d, source s, batch_id s, year i, month i",
    f"""SELECT *, {scans._coordinate(0)} AS latitude, {scans._coordinate(1)} AS longitude,
          'open_meteo' AS source, 'w1' AS batch_id, year(event_time_utc) AS year,
          month(event_time_utc) AS month FROM weather""",
    "weather",
)
def mart_weather_silver(spark, sf_dir):
    path = scans.weather_payloads(spark, sf_dir)
    rows = payloads.read_weather(spark, path, path, one_per_file=False)
    return marts.weather_silver(rows, marts.location_frame(spark), "w1")
