"""Lag, rolling, gap, z-score and regime queries."""

from __future__ import annotations

from panelspark import constants as K
from panelspark.operators import windows as W
from panelspark.plans import fixtures as X
from panelspark.plans.registered.aggregates import SHARE, matched_table
from panelspark.plans.registered.spec import query

_Z = K.IMPACT_PREDICTORS


@query(
    "price_change",
    "bzn s, valid_time_utc t, price_day_ahead d, price_change_eur_mwh d",
    "SELECT * FROM dynamics",
    "dynamics",
)
def price_change(spark, sf_dir):
    return X.market_hourly(spark, sf_dir)


@query(
    "rolling_volatility",
    "bzn s, valid_time_utc t, price_volatility_24h d",
    "SELECT * FROM dynamics",
    "dynamics",
)
def rolling_volatility(spark, sf_dir):
    return X.market_hourly(spark, sf_dir)


@query(
    "missing_hour_intervals",
    "location s, missing_hour_intervals i",
    """SELECT location, count(*) FILTER (step > INTERVAL 1 HOUR) AS missing_hour_intervals
       FROM (SELECT location, event_time_utc - lag(event_time_utc)
               OVER (PARTITION BY location ORDER BY event_time_utc) AS step FROM weather)
       GROUP BY location""",
    "weather",
)
def missing_hour_intervals(spark, sf_dir):
    return W.missing_hour_intervals(X.actual_weather(spark, sf_dir), ["location"], "event_time_utc")


@query(
    "resolution_minutes",
    "bzn s, metric s, resolution_minutes d",
    """SELECT bzn, metric, median(epoch_us(event_time_utc) - epoch_us(before)) / 60000000.0 AS resolution_minutes
       FROM (SELECT *, lag(event_time_utc) OVER (PARTITION BY bzn, metric ORDER BY event_time_utc) AS before
             FROM (SELECT DISTINCT bzn, metric, event_time_utc FROM market))
       GROUP BY ALL""",
    "market",
)
def resolution_minutes(spark, sf_dir):
    observations = X.market_observations(spark, sf_dir)
    return W.resolution_minutes(observations, ["bzn", "metric"], "event_time_utc")


_KEYS = "bzn s, forecast_run_utc t, valid_time_utc t"


@query(
    "zscore_within_group",
    _KEYS + ", " + ", ".join(f"z_{p} d" for p in _Z),
    "SELECT m.bzn, forecast_run_utc, valid_time_utc, "
    + ", ".join(f"({p} - m_{p}) / nullif(s_{p}, 0) AS z_{p}" for p in _Z)
    + " FROM matched m LEFT JOIN (SELECT bzn, "
    + ", ".join(f"avg({p}) AS m_{p}, stddev_samp({p}) AS s_{p}" for p in _Z)
    + " FROM matched GROUP BY bzn) z USING (bzn)",
    "matched",
)
def zscore_within_group(spark, sf_dir):
    return W.zscore_within_group(matched_table(spark, sf_dir), ["bzn"], _Z)


@query(
    "zscore_global",
    _KEYS + ", " + ", ".join(f"z_{p} d" for p in _Z),
    "SELECT bzn, forecast_run_utc, valid_time_utc, "
    + ", ".join(
        f"CASE WHEN coalesce(s_{p}, 0) = 0 THEN 0.0 ELSE ({p} - m_{p}) / s_{p} END AS z_{p}" for p in _Z
    )
    + " FROM matched, (SELECT "
    + ", ".join(f"avg({p}) AS m_{p}, stddev_samp({p}) AS s_{p}" for p in _Z)
    + " FROM matched)",
    "matched",
)
def zscore_global(spark, sf_dir):
    return W.zscore_global(matched_table(spark, sf_dir), _Z)


@query(
    "regime_within_group",
    _KEYS + ", high_renewable_regime i",
    f"""SELECT bzn, forecast_run_utc, valid_time_utc,
          CAST(coalesce({SHARE} >= med, false) AS INT) AS high_renewable_regime
        FROM matched LEFT JOIN (SELECT bzn, median({SHARE}) AS med FROM matched GROUP BY bzn) USING (bzn)""",
    "matched",
)
def regime_within_group(spark, sf_dir):
    return W.regime_within_group(matched_table(spark, sf_dir), ["bzn"], SHARE)


@query(
    "regime_global",
    _KEYS + ", high_renewable_regime i",
    f"""SELECT bzn, forecast_run_utc, valid_time_utc, CAST(coalesce({SHARE} >=
          (SELECT median({SHARE}) FROM matched), false) AS INT) AS high_renewable_regime FROM matched""",
    "matched",
)
def regime_global(spark, sf_dir):
    return W.regime_global(matched_table(spark, sf_dir), SHARE)
