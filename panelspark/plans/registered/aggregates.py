"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.operators import aggregates as A
from panelspark.operators import guards
from panelspark.operators.reshape import pivot_metrics
from panelspark.operators.windows import regime_global, regime_within_group
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.plans.registered.scans import overall_sql
from panelspark.plans.registered.spec import query
from panelspark.session import materialize
from panelspark.sources import files

SHARE = "actual_renewable_share_of_load"
_GLOBAL_REGIME = (
    f"(SELECT *, CAST(coalesce({SHARE} >= (SELECT median({SHARE}) FROM matched), false) AS INT)"
    " AS high_renewable_regime, CAST(floor(forecast_horizon_hours / 24) * 24 AS BIGINT)"
    " AS horizon_bin_start_hours FROM matched)"
)
_ZONE_REGIME = (
    f"(SELECT m.*, CAST(coalesce({SHARE} >= z.med, false) AS INT) AS high_renewable_regime"
    f" FROM matched m LEFT JOIN (SELECT bzn, median({SHARE}) AS med FROM matched GROUP BY bzn) z"
    " USING (bzn))"
)


def matched(spark, sf_dir):
    return X.impact_panel(spark, sf_dir).where("market_match_flag")


def matched_table(spark, sf_dir):
    """The matched rows written once, for operators that read them twice."""
    return materialize(matched(spark, sf_dir), "matched")


def energy_weather_table(spark, sf_dir):
    """The energy-weather panel written once, as the Gold mart would be."""
    return materialize(X.energy_weather(spark, sf_dir), "energy-weather")


def matched_with_bins(spark, sf_dir):
    return marts.add_horizon_bins(matched(spark, sf_dir))


@query(
    "hourly_mean_pivot",
    "bzn s, valid_time_utc t, " + ", ".join(f"{m} d" for m in K.MARKET_METRICS),
    # the events hold the first five metrics
    "SELECT *, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in K.MARKET_METRICS[5:]) + " FROM hourly",
    "hourly",
)
def hourly_mean_pivot(spark, sf_dir):
    observations = X.market_observations(spark, sf_dir).withColumn(
        "valid_time_utc", F.date_trunc("hour", "event_time_utc")
    )
    return pivot_metrics(observations, ["bzn", "valid_time_utc"], K.MARKET_METRICS)


@query(
    "weather_hourly_agg",
    "event_time_utc t, weather_location_count i, temperature_2m_c_mean d, relative_humidity_2m_pct_mean d, "
    "precipitation_mm_mean d, precipitation_mm_max d, wind_speed_10m_kmh_mean d, wind_speed_10m_kmh_max d, "
    "shortwave_radiation_w_m2_mean d",
    "SELECT * FROM weather_hours",
    "weather_hours",
)
def weather_hourly_agg(spark, sf_dir):
    return A.weather_by_hour(X.actual_weather(spark, sf_dir))


@query(
    "vintage_hour_agg",
    "forecast_run_utc t, valid_time_utc t, forecast_horizon_hours d, weather_location_count i, "
    "weather_location_complete b, " + ", ".join(f"{c} d" for c in K.WEATHER_ERRORS),
    "SELECT *, weather_location_count >= 2 AS weather_location_complete FROM vintage_hours",
    "vintage_hours",
)
def vintage_hour_agg(spark, sf_dir):
    return A.errors_by_vintage_hour(X.forecast_errors(spark, sf_dir))


_METRIC_COLUMNS = (
    "variable s, variable_label s, n i, bias_forecast_minus_actual d, mae d, rmse d, max_absolute_error d"
)


@query("error_metrics_overall", _METRIC_COLUMNS, overall_sql(), "errors")
def error_metrics_overall(spark, sf_dir):
    return A.error_metrics(X.forecast_errors(spark, sf_dir), labelled=True)


@query(
    "error_metrics_horizon",
    "horizon_bin s, horizon_bin_start_hours i, " + _METRIC_COLUMNS,
    overall_sql("horizon_bin, horizon_bin_start_hours"),
    "errors",
)
def error_metrics_horizon(spark, sf_dir):
    keys = ["horizon_bin", "horizon_bin_start_hours"]
    return A.error_metrics(X.forecast_errors(spark, sf_dir), keys, labelled=True)


@query("error_metrics_location", "location s, " + _METRIC_COLUMNS, overall_sql("location"), "errors")
def error_metrics_location(spark, sf_dir):
    return A.error_metrics(X.forecast_errors(spark, sf_dir), ["location"], labelled=True)


@query(
    "error_metrics_location_horizon",
    "location s, horizon_bin s, horizon_bin_start_hours i, " + _METRIC_COLUMNS,
    overall_sql("location, horizon_bin, horizon_bin_start_hours"),
    "errors",
)
def error_metrics_location_horizon(spark, sf_dir):
    keys = ["location", "horizon_bin", "horizon_bin_start_hours"]
    return A.error_metrics(X.forecast_errors(spark, sf_dir), keys, labelled=True)


def _outcome(name, keys, key_columns, measures, source, build, distinct=None, times=()):
    """Register an outcome table; the SQL mirrors the measure list."""
    functions = []
    for m in measures:
        function, column = A.OUTCOME_MEASURES[m]
        functions.append(f"{function}({column}) AS {m}")
    for out, column in (distinct or {}).items():
        functions.append(f"count(DISTINCT {column}) AS {out}")
    columns = [key_columns, "rows i"]
    columns += [f"{m} t" if m in times else f"{m} d" for m in measures]
    columns += [f"{out} i" for out in distinct or {}]
    sql = f"SELECT {', '.join(keys)}, count(*) AS rows, {', '.join(functions)} FROM {source} GROUP BY ALL"

    @query(name, ", ".join(columns), sql, "matched")
    def run(spark, sf_dir):
        return A.outcome_table(build(spark, sf_dir), keys, measures, distinct)

    return run


_outcome(
    "outcomes_by_horizon",
    ["horizon_bin_start_hours"],
    "horizon_bin_start_hours i",
    ["mean_price", "price_std", "negative_price_rate", "mean_temperature_error", "mean_wind_error",
     "mean_radiation_error", "mean_load_forecast_error"],
    _GLOBAL_REGIME,
    matched_with_bins,
)
_outcome(
    "outcomes_by_regime",
    ["high_renewable_regime"],
    "high_renewable_regime i",
    ["mean_price", "price_volatility", "negative_price_rate", "mean_temperature_error",
     "mean_wind_error", "mean_radiation_error"],
    _GLOBAL_REGIME,
    lambda spark, sf_dir: regime_global(matched_table(spark, sf_dir), SHARE),
)
_outcome(
    "vintage_coverage",
    ["forecast_run_utc"],
    "forecast_run_utc t",
    ["valid_start_utc", "valid_end_utc", "mean_price", "negative_price_rate",
     "mean_temperature_error", "mean_radiation_error"],
    "matched",
    matched,
    times=("valid_start_utc", "valid_end_utc"),
)
_outcome(
    "horizon_regime_stability",
    ["horizon_bin_start_hours", "high_renewable_regime"],
    "horizon_bin_start_hours i, high_renewable_regime i",
    ["mean_price", "negative_price_rate", "mean_temperature_error", "mean_radiation_error"],
    _GLOBAL_REGIME,
    lambda spark, sf_dir: marts.add_horizon_bins(
        regime_global(matched_table(spark, sf_dir), SHARE)
    ),
)
_outcome(
    "zone_coverage",
    ["bzn"],
    "bzn s",
    ["mean_price", "negative_price_rate"],
    "matched",
    matched,
    distinct={"valid_hours": "valid_time_utc", "forecast_runs": "forecast_run_utc"},
)
_outcome(
    "zone_regime_summary",
    ["bzn", "high_renewable_regime"],
    "bzn s, high_renewable_regime i",
    ["mean_price", "negative_price_rate", "mean_temperature_error", "mean_radiation_error"],
    _ZONE_REGIME,
    lambda spark, sf_dir: regime_within_group(matched_table(spark, sf_dir), ["bzn"], SHARE),
)


@query(
    "zone_price_coverage",
    "region s, rows i, start_time_utc t, end_time_utc t, price_missing i, model_rows i",
    """SELECT region, count(*) AS rows, min(event_time_utc) AS start_time_utc,
         max(event_time_utc) AS end_time_utc,
         count(*) FILTER (price_day_ahead_eur_mwh IS NULL) AS price_missing,
         count(price_day_ahead_eur_mwh) AS model_rows FROM zone_panel GROUP BY region""",
    "zone_panel",
)
def zone_price_coverage(spark, sf_dir):
    return A.price_coverage(X.zone_panel(spark, sf_dir))


_CONDITIONS = {
    "all": "true", "rain": "rain_flag", "no_rain": "NOT rain_flag", "high_wind": "high_wind_flag",
    "not_high_wind": "NOT high_wind_flag", "cold": "cold_weather_flag",
    "not_cold": "NOT cold_weather_flag",
}


@query(
    "condition_summary",
    "condition s, rows i, mean_price_eur_mwh d, median_price_eur_mwh d, negative_price_rate d, "
    "price_spike_rate d, mean_renewable_share d",
    " UNION ALL ".join(
        f"SELECT '{name}' AS condition, count(*) AS rows, avg(price_day_ahead_eur_mwh) AS mean_price_eur_mwh,"
        " median(price_day_ahead_eur_mwh) AS median_price_eur_mwh,"
        " avg(negative_price_flag::INT) AS negative_price_rate, avg(price_spike_flag::INT) AS price_spike_rate,"
        f" avg(renewable_share) AS mean_renewable_share FROM energy_weather WHERE {mask}"
        for name, mask in _CONDITIONS.items()
    ),
    "energy_weather",
)
def condition_summary(spark, sf_dir):
    return A.condition_summary(energy_weather_table(spark, sf_dir))


@query(
    "quantile_bin_curve",
    "bin i, rows i, renewable_share_pct d, mean_price d, negative_rate d",
    """SELECT (SELECT count(*) FROM inner_edges e WHERE c.x > e.edge) AS bin, count(*) AS rows,
         avg(x) AS renewable_share_pct, avg(price) AS mean_price, avg(neg) AS negative_rate
       FROM (SELECT renewable_share * 100 AS x, price_day_ahead_eur_mwh AS price, negative_price_flag::INT AS neg
             FROM zone_panel WHERE renewable_share IS NOT NULL AND price_day_ahead_eur_mwh IS NOT NULL) c,
         (SELECT 1) GROUP BY bin""".replace(
        "inner_edges",
        """(SELECT edge FROM (SELECT DISTINCT unnest(quantile_cont(renewable_share * 100,
             list_transform(range(21), lambda i: i / 20.0))) AS edge FROM zone_panel
             WHERE renewable_share IS NOT NULL AND price_day_ahead_eur_mwh IS NOT NULL)
           QUALIFY row_number() OVER (ORDER BY edge) > 1 AND row_number() OVER (ORDER BY edge DESC) > 1)""",
    ),
    "zone_panel",
)
def quantile_bin_curve(spark, sf_dir):
    panel = X.zone_panel(spark, sf_dir).select(
        (F.col("renewable_share") * 100).alias("renewable_share_pct"),
        "price_day_ahead_eur_mwh",
        F.col("negative_price_flag").cast("int").alias("negative"),
    ).dropna()
    panel = materialize(panel, "curve")
    means = {"mean_price": "price_day_ahead_eur_mwh", "negative_rate": "negative"}
    return A.quantile_bin_curve(panel, "renewable_share_pct", means)


_LONG_ABSOLUTE = " UNION ALL ".join(
    f"SELECT horizon_bin_start_hours, '{v}' AS variable, {v}_absolute_error AS e FROM errors"
    f" WHERE {v}_absolute_error IS NOT NULL"
    for v in K.WEATHER_VARIABLES
)


@query(
    "error_distribution",
    "horizon_bin_start_hours i, variable s, n i, q1 d, median d, q3 d, whisker_low d, whisker_high d",
    f"""SELECT horizon_bin_start_hours, variable, any_value(n) AS n, any_value(q[1]) AS q1,
          any_value(q[2]) AS median, any_value(q[3]) AS q3,
          min(e) FILTER (e >= q[1] - 1.5 * (q[3] - q[1]) AND e <= q[3] + 1.5 * (q[3] - q[1])) AS whisker_low,
          max(e) FILTER (e >= q[1] - 1.5 * (q[3] - q[1]) AND e <= q[3] + 1.5 * (q[3] - q[1])) AS whisker_high
        FROM ({_LONG_ABSOLUTE}) JOIN (SELECT horizon_bin_start_hours, variable, count(*) AS n,
            quantile_cont(e, [0.25, 0.5, 0.75]) AS q FROM ({_LONG_ABSOLUTE}) GROUP BY ALL) USING (horizon_bin_start_hours, variable)
        GROUP BY horizon_bin_start_hours, variable""",
    "errors",
)
def error_distribution(spark, sf_dir):
    absolute = [f"{v}_absolute_error" for v in K.WEATHER_VARIABLES]
    errors = X.forecast_errors(spark, sf_dir).select("horizon_bin_start_hours", *absolute)
    return A.error_distribution(materialize(errors, "errors"))


@query(
    "duplicate_key_count",
    "duplicate_key_count i, rows i",
    """SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_key_count,
         count(*) AS rows FROM lineitem""",
)
def duplicate_key_count(spark, sf_dir):
    items = X.table(spark, sf_dir, "lineitem")
    return guards.duplicate_key_count(items, ["l_orderkey", "l_linenumber"])


_COUNTED = ["load_actual_mw", "wind_generation_mw", "renewable_share", "price_day_ahead_eur_mwh"]


@query(
    "missing_by_column",
    "column_name s, missing i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM zone_panel"
        for c in _COUNTED
    ),
    "zone_panel",
)
def missing_by_column(spark, sf_dir):
    return A.null_counts(X.zone_panel(spark, sf_dir), _COUNTED)


@query(
    "source_report",
    "location s, rows i, start_time_utc t, end_time_utc t, invalid_timestamp_count i, "
    "duplicate_key_count i, missing_temperature_2m_c i, missing_precipitation_mm i",
    """SELECT location, count(*) AS rows, min(event_time_utc) AS start_time_utc,
         max(event_time_utc) AS end_time_utc, 0 AS invalid_timestamp_count,
         count(*) - count(DISTINCT event_time_utc) AS duplicate_key_count,
         count(*) FILTER (temperature_2m_c IS NULL) AS missing_temperature_2m_c,
         count(*) FILTER (precipitation_mm IS NULL) AS missing_precipitation_mm
       FROM weather GROUP BY location""",
    "weather",
)
def source_report(spark, sf_dir):
    return A.source_report(
        X.actual_weather(spark, sf_dir), ["location"], "event_time_utc",
        ["location", "event_time_utc"], ["temperature_2m_c", "precipitation_mm"],
    )


@query(
    "distinct_sets",
    "bzn s, metrics l, metric_count i",
    """SELECT bzn, list_sort(list(DISTINCT metric)) AS metrics, count(DISTINCT metric) AS metric_count
       FROM market GROUP BY bzn""",
    "market",
)
def distinct_sets(spark, sf_dir):
    pairs = X.market_observations(spark, sf_dir).select("bzn", "metric").distinct()
    return pairs.groupBy("bzn").agg(
        F.array_sort(F.collect_set("metric")).alias("metrics"),
        F.count(F.lit(1)).alias("metric_count"),
    )


@query(
    "match_rate",
    "rows i, matched_rows i, unmatched_rows i, match_rate d",
    """SELECT count(*) AS rows, count(*) FILTER (actual_match_flag) AS matched_rows,
         count(*) FILTER (NOT actual_match_flag) AS unmatched_rows,
         avg(actual_match_flag::INT) AS match_rate FROM errors""",
    "errors",
)
def match_rate(spark, sf_dir):
    return A.match_summary(X.forecast_errors(spark, sf_dir), "actual_match_flag")


@query(
    "zone_report",
    "region s, available_metric_count i, missing_required_metrics l, wind_source_metric s, rows i, "
    "start_time_utc t, end_time_utc t, missing_price_rows i, missing_renewable_share_rows i, negative_price_rows i",
    f"""SELECT region, any_value(c) AS available_metric_count, any_value(mm) AS missing_required_metrics,
          wind_source_metric, count(*) AS rows, min(event_time_utc) AS start_time_utc,
          max(event_time_utc) AS end_time_utc,
          count(*) FILTER (price_day_ahead_eur_mwh IS NULL) AS missing_price_rows,
          count(*) FILTER (renewable_share IS NULL) AS missing_renewable_share_rows,
          count(*) FILTER (negative_price_flag) AS negative_price_rows
        FROM zone_panel JOIN (SELECT region, count(DISTINCT metric) AS c,
            list_filter({sorted(K.COMMON_METRICS)}, lambda m: NOT list_contains(list(DISTINCT metric), m)) AS mm
          FROM research GROUP BY region) USING (region)
        GROUP BY region, wind_source_metric""",
    "zone_panel",
)
def zone_report(spark, sf_dir):
    long = X.research_long(spark, sf_dir)
    return marts.zone_report(long, marts.multi_zone_panel(long, X.RESEARCH_ZONES, "b1"))


@query("artifact_files", "artifact s, file_count i, bytes i")
def artifact_files(spark, sf_dir):
    listed = files.list_files(spark, sf_dir, "*.parquet")
    named = listed.withColumn("artifact", F.regexp_extract("path", r"([^/]+)\.parquet$", 1))
    return files.artifact_files(named)
