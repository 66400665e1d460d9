"""Silver tables and Gold marts composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.functions import columns as C
from panelspark.operators.aggregates import errors_by_vintage_hour, weather_by_hour
from panelspark.operators.guards import refuse_duplicates, require_columns
from panelspark.operators.joins import left_join_indicator, left_join_marked, require_mapped
from panelspark.operators.reshape import map_dimensions, melt, pivot_metrics
from panelspark.operators.windows import price_dynamics, resolution_minutes
from panelspark.session import materialize


def silver_long(
    wide: DataFrame,
    mapping: DataFrame,
    time: str,
    local_time: str,
    values: Sequence[str],
    batch_id: str,
    ingested_at: str,
) -> DataFrame:
    """Wide time-series CSV rows to the long Silver table.

    Rows whose time could not be parsed are kept with a null time, so that
    the quality counters can see them; drop them with ``with_valid_time``.
    """
    # the time is parsed once per wide row, before the row is cut into values
    stamp = C.to_timestamp(time) if dict(wide.dtypes)[time] == "string" else F.col(time)
    timed = wide.withColumns(
        {"event_time_utc": stamp, "_year": F.year(stamp), "_month": F.month(stamp)}
    )
    long = melt(timed, ["event_time_utc", "_year", "_month", local_time], values)
    stamped = map_dimensions(long, mapping)
    return stamped.select(
        F.lit("opsd").alias("source"),
        "region",
        "metric",
        "source_column",
        "event_time_utc",
        F.col(local_time).cast("string").alias("event_time_local"),
        "value",
        "unit",
        F.lit(ingested_at).alias("ingested_at_utc"),
        F.lit(batch_id).alias("batch_id"),
        F.col("_year").cast("smallint").alias("year"),
        F.col("_month").cast("tinyint").alias("month"),
    )


def with_valid_time(long: DataFrame, time: str = "event_time_utc") -> DataFrame:
    return long.where(F.col(time).isNotNull())


def _energy_derivations(wide: DataFrame) -> DataFrame:
    renewable = F.col("solar_generation_mw") + F.col("wind_generation_mw")
    error = C.load_error("load_actual_mw", "load_forecast_mw", "actual_minus_forecast")
    derived = wide.withColumns(
        {"renewable_generation_mw": renewable, "load_forecast_error_mw": error}
    )
    calendar = C.calendar_fields("event_time_utc")
    calendar.pop("valid_date")
    price = F.col("price_day_ahead_eur_mwh")
    return derived.withColumns(
        {
            "renewable_share": C.guarded_ratio("renewable_generation_mw", "load_actual_mw"),
            "load_forecast_error_pct": C.guarded_ratio("load_forecast_error_mw", "load_forecast_mw"),
            "negative_price_flag": C.flag_below(price, 0.0),
            "price_spike_flag": C.flag_at_least(price, K.PRICE_SPIKE),
            **calendar,
        }
    )


# Silver metric -> column of the energy marts.
ENERGY_NAMES = {
    K.LOAD_ACTUAL: "load_actual_mw",
    K.LOAD_FORECAST: "load_forecast_mw",
    K.PRICE: "price_day_ahead_eur_mwh",
    K.SOLAR: "solar_generation_mw",
}

ENERGY_COLUMNS = [
    "load_actual_mw",
    "load_forecast_mw",
    "load_forecast_error_mw",
    "load_forecast_error_pct",
    "solar_generation_mw",
    "wind_generation_mw",
    "renewable_generation_mw",
    "renewable_share",
    "price_day_ahead_eur_mwh",
    "negative_price_flag",
    "price_spike_flag",
    "hour_utc",
    "day_of_week",
    "is_weekend",
]


def energy_research(
    long: DataFrame, region: str, batch_id: str, created_at: str, check: bool = True
) -> DataFrame:
    """Hourly research mart of one region from the long Silver table."""
    rows = long.where(F.col("region") == region).select("metric", "event_time_utc", "value")
    if check:
        present = {
            r[0]
            for r in rows.where(F.col("metric").isin(*K.RESEARCH_METRICS))
            .select("metric").distinct().collect()
        }
        missing = sorted(set(K.RESEARCH_METRICS) - present)
        if missing:
            raise ValueError(f"region {region} lacks required metrics: {missing}")
    wide = pivot_metrics(rows, ["event_time_utc"], K.RESEARCH_METRICS, how="strict", every_key=True)
    wide = wide.withColumnsRenamed({**ENERGY_NAMES, K.WIND: "wind_generation_mw"})
    return _energy_derivations(wide).select(
        "event_time_utc",
        F.lit(region).alias("region"),
        *ENERGY_COLUMNS,
        F.lit("opsd").alias("source"),
        F.lit(batch_id).alias("silver_batch_id"),
        F.lit(created_at).alias("created_at_utc"),
        "year",
        "month",
    )


def zone_wind_source(long: DataFrame) -> DataFrame:
    """(region, wind_source_metric): decided once for the whole zone."""
    has = {m: F.max((F.col("metric") == m).cast("int")) for m in (K.WIND, K.WIND_ONSHORE)}
    source = F.when(has[K.WIND] == 1, K.WIND).when(has[K.WIND_ONSHORE] == 1, K.WIND_ONSHORE)
    return long.groupBy("region").agg(source.alias("wind_source_metric"))


def multi_zone_panel(long: DataFrame, zones: Sequence[str], batch_id: str) -> DataFrame:
    """Unbalanced hourly panel of several regions with a named wind source."""
    rows = long.where(F.col("region").isin(*zones)).select(
        "region", "metric", "event_time_utc", "value"
    )
    metrics = [*K.COMMON_METRICS, K.WIND, K.WIND_ONSHORE]
    wide = pivot_metrics(rows, ["region", "event_time_utc"], metrics, how="strict", every_key=True)
    # at most one row per requested zone
    sources = F.broadcast(zone_wind_source(rows))
    wide = wide.join(sources, "region").withColumnsRenamed(ENERGY_NAMES)
    wind = F.when(F.col("wind_source_metric") == K.WIND, F.col(K.WIND)).when(
        F.col("wind_source_metric") == K.WIND_ONSHORE, F.col(K.WIND_ONSHORE)
    )
    derived = _energy_derivations(wide.withColumn("wind_generation_mw", wind))
    return derived.select(
        "region",
        "event_time_utc",
        *ENERGY_COLUMNS,
        "wind_source_metric",
        F.lit("opsd").alias("source"),
        F.lit(batch_id).alias("silver_batch_id"),
        "year",
        "month",
    )


def weather_flags(panel: DataFrame, complete_count: int = 2) -> DataFrame:
    count = F.col("weather_location_count")
    return panel.withColumns(
        {
            "weather_complete_flag": F.coalesce(count == complete_count, F.lit(False)),
            "rain_flag": C.flag_above("precipitation_mm_mean", 0.0, 0.0),
            "heavy_rain_flag": C.flag_at_least("precipitation_mm_max", K.HEAVY_RAIN_MM, 0.0),
            "high_wind_flag": C.flag_at_least("wind_speed_10m_kmh_max", K.HIGH_WIND_KMH, 0.0),
            "cold_weather_flag": C.flag_below("temperature_2m_c_mean", K.FREEZING_C, 99.0),
        }
    )


def energy_weather_panel(
    energy: DataFrame, weather: DataFrame, weather_batch_id: str, joined_at: str,
    complete_count: int = 2, check: bool = True,
) -> DataFrame:
    """Energy hours with the weather of the same hour, unmatched hours kept."""
    hourly = weather_by_hour(weather)
    if check:
        refuse_duplicates(energy, ["event_time_utc"], "energy mart")
    # the weather side is grouped by the join key, hence unique
    joined = left_join_indicator(
        energy, hourly, ["event_time_utc"], "weather_join_status", cardinality=None
    )
    return weather_flags(joined, complete_count).withColumns(
        {
            "weather_energy_joined_at_utc": F.lit(joined_at),
            "weather_silver_batch_id": F.lit(weather_batch_id),
        }
    )


def add_errors(joined: DataFrame) -> DataFrame:
    """Signed and absolute error per weather variable."""
    columns = {}
    for name, (forecast, actual) in K.WEATHER_VARIABLES.items():
        signed, absolute = C.error_pair(forecast, f"{actual}_actual")
        columns[f"{name}_error"] = signed
        columns[f"{name}_absolute_error"] = absolute
    return joined.withColumns(columns)


def add_horizon_bins(df: DataFrame, width: int = 24) -> DataFrame:
    start = C.horizon_bin_start("forecast_horizon_hours", width)
    return df.withColumn("horizon_bin_start_hours", start).withColumn(
        "horizon_bin", C.horizon_bin_label("horizon_bin_start_hours", width)
    )


def forecast_error_mart(
    forecast: DataFrame, actual: DataFrame, bin_hours: int = 24,
    forecast_unique: bool = True, check: bool = True,
) -> DataFrame:
    """Forecast vintages against the weather observed at the valid hour.

    One run or many: runs are rows. Unmatched forecasts stay, with a false
    ``actual_match_flag``.
    """
    forecasts = [f for f, _ in K.WEATHER_VARIABLES.values()]
    actuals = [a for _, a in K.WEATHER_VARIABLES.values()]
    key = ["location", "forecast_run_utc", "valid_time_utc"]
    require_columns(forecast, [*key, "forecast_horizon_hours", *forecasts], "forecast Silver")
    require_columns(actual, ["location", "event_time_utc", *actuals], "actual Silver")
    if check:
        refuse_duplicates(actual, ["location", "event_time_utc"], "actual weather")
        if forecast_unique:
            refuse_duplicates(forecast, key, "forecast vintages")
    lineage = (
        F.col("batch_id") if "batch_id" in actual.columns else F.lit(None).cast("string")
    ).alias("actual_batch_id")
    observed = actual.select(
        "location",
        F.col("event_time_utc").alias("valid_time_utc"),
        *[F.col(a).alias(f"{a}_actual") for a in actuals],
        lineage,
    )
    joined = left_join_marked(
        forecast, observed, ["location", "valid_time_utc"], "actual_match_flag", cardinality=None
    )
    binned = add_horizon_bins(add_errors(joined), bin_hours)
    return binned.withColumns(
        {
            "run_date": F.date_format("forecast_run_utc", "yyyy-MM-dd"),
            "valid_year": F.year("valid_time_utc").cast("smallint"),
            "valid_month": F.month("valid_time_utc").cast("tinyint"),
        }
    )


def market_hourly(
    market: DataFrame, zone: Sequence[str] = ("bzn",), window: int = 24, minimum: int = 12
) -> DataFrame:
    """Market observations of any resolution to one row per zone and UTC hour."""
    require_columns(market, [*zone, "event_time_utc", "metric", "value"], "market Silver")
    timed = market.where(F.col("event_time_utc").isNotNull()).withColumn(
        "valid_time_utc", C.hour_floor("event_time_utc")
    )
    hourly = pivot_metrics(timed, [*zone, "valid_time_utc"], K.MARKET_METRICS)
    dynamic = price_dynamics(hourly, zone=zone, window=window, minimum=minimum)
    market_error = {
        f"{name}_forecast_error_mw": C.load_error(
            f"actual_{name}", f"forecast_{name}", "forecast_minus_actual"
        )
        for name in ("load", "solar", "wind_onshore", "wind_offshore")
    }
    return dynamic.withColumns(
        {
            "negative_price_flag": C.flag_below("price_day_ahead", 0.0).cast("tinyint"),
            **market_error,
        }
    )


MARKET_RESULT_COLUMNS = [
    *K.MARKET_METRICS,
    "price_change_eur_mwh",
    "price_volatility_24h",
    "negative_price_flag",
    "load_forecast_error_mw",
    "solar_forecast_error_mw",
    "wind_onshore_forecast_error_mw",
    "wind_offshore_forecast_error_mw",
]


def _impact_columns(
    panel: DataFrame, extra: Sequence[str], market_batch_id: str | None, weather_batch_id: str | None
) -> DataFrame:
    return panel.select(
        "forecast_run_utc",
        "valid_time_utc",
        "forecast_horizon_hours",
        "weather_location_count",
        "weather_location_complete",
        "market_match_flag",
        C.known_at("forecast_run_utc", "valid_time_utc").alias("forecast_availability_proxy"),
        *extra,
        *K.WEATHER_ERRORS,
        *MARKET_RESULT_COLUMNS,
        F.lit(market_batch_id).cast("string").alias("market_batch_id"),
        F.lit(weather_batch_id).cast("string").alias("weather_batch_id"),
        F.date_format("forecast_run_utc", "yyyy-MM-dd").alias("run_date"),
        F.year("valid_time_utc").cast("smallint").alias("valid_year"),
        F.month("valid_time_utc").cast("tinyint").alias("valid_month"),
    )


def forecast_impact(
    market: DataFrame, errors: DataFrame, bzn: str, complete_from: int = 2,
    window: int = 24, minimum: int = 12,
    market_batch_id: str | None = None, weather_batch_id: str | None = None,
) -> DataFrame:
    """Weather errors averaged over all points against one zone's market."""
    hourly = market_hourly(
        market.where(F.col("bzn") == bzn), window=window, minimum=minimum
    ).drop("bzn")
    weather = errors_by_vintage_hour(errors, complete_from=complete_from)
    # the market side is grouped by the join key, hence unique
    joined = left_join_marked(
        weather, hourly, ["valid_time_utc"], "market_match_flag", cardinality=None
    )
    return _impact_columns(
        joined.withColumn("bzn", F.lit(bzn)), ["bzn"], market_batch_id, weather_batch_id
    )


def multi_zone_forecast_impact(
    market: DataFrame, errors: DataFrame, zone_map: DataFrame,
    window: int = 24, minimum: int = 12, check: bool = True,
    market_batch_id: str | None = None, weather_batch_id: str | None = None,
) -> DataFrame:
    """Each zone's market against the errors of its own weather point.

    One join for all zones. ``zone_map`` (bzn, location) is a small table that
    Catalyst broadcasts by size; zones may share a location. With ``check`` a
    market zone without a mapping is an error.
    """
    if check:
        require_mapped(market, zone_map, "bzn")
    hourly = market_hourly(market, window=window, minimum=minimum)
    weather = errors_by_vintage_hour(errors, ["location"], complete_from=1)
    zoned = weather.join(zone_map, "location").withColumnRenamed("location", "weather_location")
    joined = left_join_marked(
        zoned, hourly, ["bzn", "valid_time_utc"], "market_match_flag", cardinality=None
    )
    return _impact_columns(joined, ["bzn", "weather_location"], market_batch_id, weather_batch_id)


def market_silver(rows: DataFrame) -> DataFrame:
    """Market rows with the native resolution of their series attached."""
    series = ["batch_id", "bzn", "metric", "series_type"]
    # one row per series, written: Catalyst sees its size before it plans the join
    steps = materialize(resolution_minutes(rows, series, "event_time_utc"), "series-resolution")
    with_step = rows.join(steps, series, "left")
    return with_step.withColumns(
        {
            "year": F.year("event_time_utc").cast("smallint"),
            "month": F.month("event_time_utc").cast("tinyint"),
        }
    )


def weather_silver(rows: DataFrame, requests: DataFrame, batch_id: str) -> DataFrame:
    """Observed weather rows with coordinates, source and batch."""
    sides = requests.select("location", "latitude", "longitude")
    return rows.join(sides, "location", "left").select(
        "event_time_utc",
        "location",
        "latitude",
        "longitude",
        *K.OBSERVED_FIELDS.values(),
        F.lit("open_meteo").alias("source"),
        F.lit(batch_id).alias("batch_id"),
        F.year("event_time_utc").cast("smallint").alias("year"),
        F.month("event_time_utc").cast("tinyint").alias("month"),
    )


def impact_report(panel: DataFrame) -> DataFrame:
    """Counters of an impact mart, as its batch report."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows_gold"),
        F.count_if("market_match_flag").alias("market_matched_rows"),
        F.count_if(~F.col("market_match_flag")).alias("market_unmatched_rows"),
        F.avg(F.col("market_match_flag").cast("int")).alias("market_match_rate"),
        F.count_if(~F.col("forecast_availability_proxy")).alias("availability_proxy_violations"),
        F.avg(F.col("weather_location_complete").cast("int")).alias(
            "weather_location_complete_rate"
        ),
    )


def zone_report(long: DataFrame, panel: DataFrame) -> DataFrame:
    """Coverage of each zone of the multi-zone panel and its metrics."""
    metrics = (
        long.select("region", "metric")
        .distinct()
        .groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("available_metric_count"),
            F.array_sort(F.array_except(
                F.array(*[F.lit(m) for m in K.COMMON_METRICS]), F.collect_set("metric")
            )).alias("missing_required_metrics"),
        )
    )
    counts = panel.groupBy("region", "wind_source_metric").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_time_utc").alias("start_time_utc"),
        F.max("event_time_utc").alias("end_time_utc"),
        F.count_if(F.col("price_day_ahead_eur_mwh").isNull()).alias("missing_price_rows"),
        F.count_if(F.col("renewable_share").isNull()).alias("missing_renewable_share_rows"),
        F.count_if("negative_price_flag").alias("negative_price_rows"),
    )
    return metrics.join(counts, "region", "left")


def location_frame(spark: SparkSession) -> DataFrame:
    rows = [(n, *xy) for n, xy in K.LOCATION_COORDINATES.items()]
    return spark.createDataFrame(rows, "location string, latitude double, longitude double")
