"""Left joins with checked cardinality."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.operators import guards, joins
from panelspark.operators.aggregates import errors_by_vintage_hour, weather_by_hour
from panelspark.plans import fixtures as X
from panelspark.plans.registered.spec import query


@query(
    "join_left_indicator",
    "event_time_utc t, price_day_ahead_eur_mwh d, temperature_2m_c_mean d, weather_join_status s",
    "SELECT * FROM energy_weather",
    "energy_weather",
)
def join_left_indicator(spark, sf_dir):
    energy = X.energy_research(spark, sf_dir)
    hourly = weather_by_hour(X.actual_weather(spark, sf_dir))
    return joins.left_join_indicator(energy, hourly, ["event_time_utc"], "weather_join_status")


@query(
    "join_vintage_actual",
    "forecast_run_utc t, valid_time_utc t, location s, temperature_forecast_c d, "
    "temperature_2m_c_actual d, actual_match_flag b",
    "SELECT * FROM errors",
    "errors",
)
def join_vintage_actual(spark, sf_dir):
    actual = X.actual_weather(spark, sf_dir).select(
        "location",
        F.col("event_time_utc").alias("valid_time_utc"),
        F.col("temperature_2m_c").alias("temperature_2m_c_actual"),
    )
    return joins.left_join_marked(
        X.forecast_vintages(spark, sf_dir), actual, ["location", "valid_time_utc"],
        "actual_match_flag",
    )


@query(
    "join_weather_market",
    "forecast_run_utc t, valid_time_utc t, forecast_horizon_hours d, weather_location_count i, "
    "weather_location_complete b, temperature_absolute_error d, price_day_ahead d, market_match_flag b",
    """SELECT v.*, weather_location_count >= 2 AS weather_location_complete, m.price_day_ahead,
         m.bzn IS NOT NULL AS market_match_flag
       FROM vintage_hours v LEFT JOIN (SELECT * FROM dynamics WHERE bzn = 'DE-LU') m
       ON m.valid_time_utc = v.valid_time_utc""",
    "vintage_hours dynamics",
)
def join_weather_market(spark, sf_dir):
    weather = errors_by_vintage_hour(X.forecast_errors(spark, sf_dir))
    market = X.market_hourly(spark, sf_dir).where("bzn = 'DE-LU'").drop("bzn")
    return joins.left_join_marked(weather, market, ["valid_time_utc"], "market_match_flag")


@query(
    "join_zone_location",
    "bzn s, weather_location s, forecast_run_utc t, valid_time_utc t, wind_speed_error d, "
    "price_day_ahead d, market_match_flag b",
    "SELECT * FROM impact",
    "impact",
)
def join_zone_location(spark, sf_dir):
    return X.impact_panel(spark, sf_dir, check=True)


@query(
    "join_cardinality",
    "l_orderkey i, l_linenumber i, n i",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def join_cardinality(spark, sf_dir):
    """The keys that would make a many-to-one join ambiguous."""
    return guards.duplicate_keys(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "missing_required",
    "region s, metric s",
    f"""SELECT r.region, m.metric FROM (SELECT DISTINCT region FROM research) r
        CROSS JOIN (SELECT unnest([{', '.join(repr(m) for m in K.RESEARCH_METRICS)}]) AS metric) m
        ANTI JOIN research USING (region, metric)""",
    "research",
)
def missing_required(spark, sf_dir):
    return guards.missing_required(
        X.research_long(spark, sf_dir), "region", "metric", K.RESEARCH_METRICS
    )


