"""Driver tables in the shape of the domain, for Spark and as SQL.

``events`` plays the market and weather stations, ``lineitem`` the wide file
and the regression sample. Each builder has a SQL twin under the same name, so
a registered query and its oracle start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark import constants as K
from panelspark.plans import marts
from panelspark.sources.runs import runs_between

HORIZON_HOURS = 240
LOCATIONS = ["frankfurt", "paris", "vienna"]
ZONES = ["DE-LU", "FR", "AT"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its footer is read for the schema only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _third(choices: list[str]) -> Column:
    third = F.col("user_id") % 3
    return F.when(third == 0, choices[0]).when(third == 1, choices[1]).otherwise(choices[2])


# Event type -> metrics it reports, each as (metric, factor, offset).
MARKET_SERIES = {
    "purchase": [("price_day_ahead", 1.0, -20.0)],
    "view": [("actual_load", 1.0, 0.0), ("actual_residual_load", 0.6, 0.0)],
    "click": [("forecast_load", 1.0, 0.0), ("forecast_wind_onshore", 0.3, 0.0)],
    "signup": [("actual_solar", 1.0, 0.0), ("actual_renewable_share_of_load", 1.0, 0.0)],
    "error": [("forecast_solar", 1.0, 0.0), ("actual_wind_onshore", 0.5, 0.0)],
}


def market_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bzn, metric, event_time_utc, value): native-resolution series."""
    series = F.lit(None).cast("array<struct<metric: string, value: double>>")
    for kind, entries in MARKET_SERIES.items():
        values = F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"),
                    (F.col("value") * F.lit(factor) + F.lit(offset)).alias("value"),
                )
                for metric, factor, offset in entries
            ]
        )
        series = F.when(F.col("event_type") == kind, values).otherwise(series)
    events = table(spark, sf_dir, "events")
    return events.select(
        _third(ZONES).alias("bzn"), F.col("ts").alias("event_time_utc"), F.explode(series).alias("s")
    ).select("bzn", "event_time_utc", "s.*")


def _market_sql() -> str:
    parts = []
    for kind, entries in MARKET_SERIES.items():
        for metric, factor, offset in entries:
            parts.append(
                "SELECT CASE user_id % 3 WHEN 0 THEN 'DE-LU' WHEN 1 THEN 'FR' ELSE 'AT' END AS bzn,"
                f" ts AS event_time_utc, '{metric}' AS metric,"
                f" value * CAST({factor} AS DOUBLE) + CAST({offset} AS DOUBLE) AS value"
                f" FROM events WHERE event_type = '{kind}'"
            )
    return " UNION ALL ".join(parts)


def actual_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, event_time_utc, variables): one row per location and hour."""
    value = F.col("value")

    def of(kind: str, expression: Column = value) -> Column:
        return F.avg(F.when(F.col("event_type") == kind, expression))

    rain = F.when(value < 30, F.lit(0.0)).otherwise(value / 10)
    return (
        table(spark, sf_dir, "events")
        .groupBy(_third(LOCATIONS).alias("location"), F.date_trunc("hour", "ts").alias("event_time_utc"))
        .agg(
            of("click", value - 20).alias("temperature_2m_c"),
            of("purchase").alias("relative_humidity_2m_pct"),
            of("error", rain).alias("precipitation_mm"),
            of("view").alias("wind_speed_10m_kmh"),
            of("signup").alias("shortwave_radiation_w_m2"),
        )
    )


_WEATHER_SQL = """
SELECT CASE user_id % 3 WHEN 0 THEN 'frankfurt' WHEN 1 THEN 'paris' ELSE 'vienna' END AS location,
  date_trunc('hour', ts) AS event_time_utc,
  avg(CASE WHEN event_type = 'click' THEN value - 20 END) AS temperature_2m_c,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS relative_humidity_2m_pct,
  avg(CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN CAST(0 AS DOUBLE) ELSE value / 10 END END) AS precipitation_mm,
  avg(CASE WHEN event_type = 'view' THEN value END) AS wind_speed_10m_kmh,
  avg(CASE WHEN event_type = 'signup' THEN value END) AS shortwave_radiation_w_m2
FROM events GROUP BY ALL"""


def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start_run, end_run): runs cover the period the events cover."""
    events = table(spark, sf_dir, "events")
    day = {f: F.date_trunc("day", getattr(F, f)("ts")) for f in ("min", "max")}
    return events.agg(day["min"].alias("a"), day["max"].alias("b")).select(
        (F.col("a") + F.expr("interval 48 hours")).alias("start_run"),
        (F.col("b") - F.expr("interval 216 hours")).alias("end_run"),
    )


def forecast_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal-naive forecasts: a run every 12 hours, 240 hours ahead.

    A forecast repeats the newest observation of the same hour of day that
    the run could know.
    """
    runs = runs_between(run_bounds(spark, sf_dir), 12, LOCATIONS)
    hours = F.sequence(F.lit(0), F.lit(HORIZON_HOURS - 1))
    grid = runs.select("*", F.explode(hours).alias("h"))
    shifted = grid.select(
        "forecast_run_utc",
        F.timestamp_add("HOUR", "h", "forecast_run_utc").alias("valid_time_utc"),
        F.col("h").cast("double").alias("forecast_horizon_hours"),
        "location",
        "latitude",
        "longitude",
        F.timestamp_add("HOUR", F.col("h") % 24 - 24, "forecast_run_utc").alias("known_at"),
    )
    source = actual_weather(spark, sf_dir).select(
        "location",
        F.col("event_time_utc").alias("known_at"),
        *[F.col(actual).alias(forecast) for forecast, actual in K.WEATHER_VARIABLES.values()],
    )
    return shifted.join(source, ["location", "known_at"]).drop("known_at").withColumn(
        "model", F.lit("seasonal_naive")
    )


_VINTAGE_SQL = """
SELECT r.run AS forecast_run_utc, r.run + to_hours(h.h) AS valid_time_utc,
  CAST(h.h AS DOUBLE) AS forecast_horizon_hours, w.location,
  w.temperature_2m_c AS temperature_forecast_c, w.wind_speed_10m_kmh AS wind_speed_forecast_kmh,
  w.shortwave_radiation_w_m2 AS shortwave_radiation_forecast_w_m2,
  w.precipitation_mm AS precipitation_forecast_mm
FROM (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP + INTERVAL 48 HOUR,
        date_trunc('day', max(ts))::TIMESTAMP - INTERVAL 216 HOUR, INTERVAL 12 HOUR)) AS run FROM events) r
CROSS JOIN (SELECT unnest(range(240)) AS h) h
JOIN weather w ON w.event_time_utc = r.run + to_hours(h.h % 24 - 24)"""


def forecast_errors(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    return marts.forecast_error_mart(
        forecast_vintages(spark, sf_dir), actual_weather(spark, sf_dir), check=check
    )


def _error_sql() -> str:
    parts = []
    for name, (forecast, actual) in K.WEATHER_VARIABLES.items():
        parts.append(f"f.{forecast}, a.{actual} AS {actual}_actual")
        parts.append(f"f.{forecast} - a.{actual} AS {name}_error")
        parts.append(f"abs(f.{forecast} - a.{actual}) AS {name}_absolute_error")
    start = "CAST(floor(f.forecast_horizon_hours / 24) * 24 AS BIGINT)"
    return f"""
SELECT f.forecast_run_utc, f.valid_time_utc, f.forecast_horizon_hours, f.location,
  a.location IS NOT NULL AS actual_match_flag, {start} AS horizon_bin_start_hours,
  concat({start}, '-', {start} + 23, 'h') AS horizon_bin, {', '.join(parts)}
FROM vintages f LEFT JOIN weather a
  ON a.location = f.location AND a.event_time_utc = f.valid_time_utc"""


def market_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.market_hourly(market_observations(spark, sf_dir))


def _hourly_sql() -> str:
    means = ", ".join(
        f"avg(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in K.MARKET_METRICS
    )
    return f"""
SELECT bzn, date_trunc('hour', event_time_utc) AS valid_time_utc, {means}
FROM market GROUP BY ALL"""


_DYNAMIC_SQL = """
SELECT *, price_day_ahead - lag(price_day_ahead) OVER z AS price_change_eur_mwh,
  CASE WHEN count(price_day_ahead) OVER t >= 12 THEN stddev_samp(price_day_ahead) OVER t END
    AS price_volatility_24h,
  CAST(coalesce(price_day_ahead < 0, false) AS TINYINT) AS negative_price_flag,
  forecast_load - actual_load AS load_forecast_error_mw,
  forecast_solar - actual_solar AS solar_forecast_error_mw,
  forecast_wind_onshore - actual_wind_onshore AS wind_onshore_forecast_error_mw,
  forecast_wind_offshore - actual_wind_offshore AS wind_offshore_forecast_error_mw
FROM hourly
WINDOW z AS (PARTITION BY bzn ORDER BY valid_time_utc),
  t AS (PARTITION BY bzn ORDER BY valid_time_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def zone_map(spark: SparkSession) -> DataFrame:
    rows = list(K.ZONE_LOCATION.items())
    return spark.createDataFrame(rows, "bzn string, location string")


def impact_panel(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    return marts.multi_zone_forecast_impact(
        market_observations(spark, sf_dir), forecast_errors(spark, sf_dir), zone_map(spark),
        check=check,
    )


def zone_impact_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone against the weather errors averaged over all locations."""
    return marts.forecast_impact(
        market_observations(spark, sf_dir), forecast_errors(spark, sf_dir), "DE-LU"
    )


def _vintage_hour_sql(extra: str) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in K.WEATHER_ERRORS)
    return f"""
SELECT {extra} forecast_run_utc, valid_time_utc, forecast_horizon_hours, {means},
  count(DISTINCT location) AS weather_location_count
FROM errors GROUP BY ALL"""


def _impact_sql() -> str:
    market = ", ".join(f"m.{c}" for c in marts.MARKET_RESULT_COLUMNS)
    weather = ", ".join(f"v.{c}" for c in K.WEATHER_ERRORS)
    cases = " ".join(f"WHEN '{loc}' THEN '{zone}'" for zone, loc in K.ZONE_LOCATION.items())
    return f"""
SELECT v.forecast_run_utc, v.valid_time_utc, v.forecast_horizon_hours, v.weather_location_count,
  v.weather_location_count >= 1 AS weather_location_complete, m.bzn IS NOT NULL AS market_match_flag,
  v.forecast_run_utc <= v.valid_time_utc AS forecast_availability_proxy, v.bzn,
  v.location AS weather_location, {weather}, {market}
FROM (SELECT *, CASE location {cases} END AS bzn FROM location_hours) v
LEFT JOIN dynamics m ON m.bzn = v.bzn AND m.valid_time_utc = v.valid_time_utc"""


RESEARCH_ZONES = ["DE_LU", "FR", "AT"]
_RESEARCH_METRIC = {
    "price_day_ahead": K.PRICE,
    "actual_load": K.LOAD_ACTUAL,
    "forecast_load": K.LOAD_FORECAST,
    "actual_solar": K.SOLAR,
}


def research_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long Silver rows (region, metric, hour, value); AT has onshore wind only."""
    observations = market_observations(spark, sf_dir)
    renamed = F.when(
        F.col("metric") == "forecast_solar",
        F.when(F.col("bzn") == "AT", K.WIND_ONSHORE).otherwise(K.WIND),
    )
    for source, target in _RESEARCH_METRIC.items():
        renamed = F.when(F.col("metric") == source, target).otherwise(renamed)
    return (
        observations.select(
            F.replace("bzn", F.lit("-"), F.lit("_")).alias("region"),
            renamed.alias("metric"),
            F.date_trunc("hour", "event_time_utc").alias("event_time_utc"),
            "value",
        )
        .where(F.col("metric").isNotNull())
        .groupBy("region", "metric", "event_time_utc")
        .agg(F.avg("value").alias("value"))
    )


def _research_sql() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in _RESEARCH_METRIC.items())
    return f"""
SELECT replace(bzn, '-', '_') AS region,
  CASE metric {cases} ELSE CASE WHEN bzn = 'AT' THEN '{K.WIND_ONSHORE}' ELSE '{K.WIND}' END END AS metric,
  date_trunc('hour', event_time_utc) AS event_time_utc, avg(value) AS value
FROM market
WHERE metric IN ('price_day_ahead', 'actual_load', 'forecast_load', 'actual_solar', 'forecast_solar')
GROUP BY ALL"""


def zone_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.multi_zone_panel(research_long(spark, sf_dir), RESEARCH_ZONES, "b1")


def _zone_panel_sql() -> str:
    def pick(metric: str) -> str:
        return f"max(CASE WHEN metric = '{metric}' THEN value END)"

    return f"""
SELECT p.*, solar_generation_mw + wind_generation_mw AS renewable_generation_mw,
  CASE WHEN load_actual_mw > 0 THEN (solar_generation_mw + wind_generation_mw) / load_actual_mw END AS renewable_share,
  load_actual_mw - load_forecast_mw AS load_forecast_error_mw,
  CASE WHEN load_forecast_mw > 0 THEN (load_actual_mw - load_forecast_mw) / load_forecast_mw END AS load_forecast_error_pct,
  coalesce(price_day_ahead_eur_mwh < 0, false) AS negative_price_flag,
  coalesce(price_day_ahead_eur_mwh >= 100, false) AS price_spike_flag,
  CAST(hour(event_time_utc) AS TINYINT) AS hour_utc,
  CAST(isodow(event_time_utc) - 1 AS TINYINT) AS day_of_week,
  isodow(event_time_utc) >= 6 AS is_weekend,
  CAST(year(event_time_utc) AS SMALLINT) AS year, CAST(month(event_time_utc) AS TINYINT) AS month
FROM (
  SELECT region, event_time_utc, {pick(K.LOAD_ACTUAL)} AS load_actual_mw,
    {pick(K.LOAD_FORECAST)} AS load_forecast_mw, {pick(K.PRICE)} AS price_day_ahead_eur_mwh,
    {pick(K.SOLAR)} AS solar_generation_mw,
    CASE WHEN s.wind = 1 THEN {pick(K.WIND)} ELSE {pick(K.WIND_ONSHORE)} END AS wind_generation_mw,
    CASE WHEN s.wind = 1 THEN '{K.WIND}' WHEN s.onshore = 1 THEN '{K.WIND_ONSHORE}' END AS wind_source_metric
  FROM research JOIN (SELECT region, max((metric = '{K.WIND}')::INT) AS wind,
      max((metric = '{K.WIND_ONSHORE}')::INT) AS onshore FROM research GROUP BY region) s USING (region)
  GROUP BY region, event_time_utc, s.wind, s.onshore) p"""


def energy_research(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    return marts.energy_research(
        research_long(spark, sf_dir), "DE_LU", "b1", "2024-02-01T00:00:00+00:00", check
    )


def energy_weather(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    return marts.energy_weather_panel(
        energy_research(spark, sf_dir, check), actual_weather(spark, sf_dir), "w1",
        "2024-02-01T00:00:00+00:00", check=check,
    )


_WEATHER_HOUR_SQL = """
SELECT event_time_utc, count(DISTINCT location) AS weather_location_count,
  avg(temperature_2m_c) AS temperature_2m_c_mean,
  avg(relative_humidity_2m_pct) AS relative_humidity_2m_pct_mean,
  avg(precipitation_mm) AS precipitation_mm_mean, max(precipitation_mm) AS precipitation_mm_max,
  avg(wind_speed_10m_kmh) AS wind_speed_10m_kmh_mean, max(wind_speed_10m_kmh) AS wind_speed_10m_kmh_max,
  avg(shortwave_radiation_w_m2) AS shortwave_radiation_w_m2_mean
FROM weather GROUP BY event_time_utc"""

_ENERGY_WEATHER_SQL = """
SELECT e.*, w.* EXCLUDE (event_time_utc),
  CASE WHEN w.event_time_utc IS NULL THEN 'left_only' ELSE 'both' END AS weather_join_status,
  coalesce(weather_location_count = 2, false) AS weather_complete_flag,
  coalesce(precipitation_mm_mean, 0) > 0 AS rain_flag,
  coalesce(precipitation_mm_max, 0) >= 5 AS heavy_rain_flag,
  coalesce(wind_speed_10m_kmh_max, 0) >= 30 AS high_wind_flag,
  coalesce(temperature_2m_c_mean, 99) < 0 AS cold_weather_flag
FROM (SELECT * FROM zone_panel WHERE region = 'DE_LU') e
LEFT JOIN weather_hours w ON w.event_time_utc = e.event_time_utc"""


def regression_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with calendar columns and a flag for the interaction."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        F.month("l_shipdate").alias("ship_month"),
        (F.col("l_discount") >= 0.05).cast("int").alias("high_discount"),
        (F.col("l_suppkey") % 6).cast("int").alias("supplier_group"),
    )


_SAMPLE_SQL = """
SELECT *, CAST(month(l_shipdate) AS INT) AS ship_month, CAST(l_discount >= 0.05 AS INT) AS high_discount,
  CAST(l_suppkey % 6 AS INT) AS supplier_group FROM lineitem"""


# name -> (names it builds on, text)
CTES: dict[str, tuple[list[str], str]] = {
    "market": ([], _market_sql()),
    "weather": ([], _WEATHER_SQL),
    "vintages": (["weather"], _VINTAGE_SQL),
    "errors": (["vintages"], _error_sql()),
    "hourly": (["market"], _hourly_sql()),
    "dynamics": (["hourly"], _DYNAMIC_SQL),
    "vintage_hours": (["errors"], _vintage_hour_sql("")),
    "location_hours": (["errors"], _vintage_hour_sql("location,")),
    "impact": (["location_hours", "dynamics"], _impact_sql()),
    "matched": (["impact"], "SELECT * FROM impact WHERE market_match_flag"),
    "research": (["market"], _research_sql()),
    "zone_panel": (["research"], _zone_panel_sql()),
    "weather_hours": (["weather"], _WEATHER_HOUR_SQL),
    "energy_weather": (["zone_panel", "weather_hours"], _ENERGY_WEATHER_SQL),
    "sample": ([], _SAMPLE_SQL),
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` preceded by the named definitions and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for below in CTES[name][0]:
            visit(below)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered)
    return f"WITH {head}\n{body.strip()}"
