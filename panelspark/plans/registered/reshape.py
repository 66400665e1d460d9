"""Projections, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.functions import columns as C
from panelspark.operators import joins, reshape
from panelspark.operators.aggregates import weather_by_hour
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.plans.registered.scans import WIDE_VALUES
from panelspark.plans.registered.spec import query


@query(
    "melt_long",
    "l_orderkey i, l_linenumber i, source_column s, value d",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS source_column, {c} AS value FROM lineitem"
        for c in WIDE_VALUES
    ),
)
def melt_long(spark, sf_dir):
    return reshape.melt(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], WIDE_VALUES)


@query(
    "coerce_numeric",
    "event_id i, number d",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE value END AS number
       FROM events""",
)
def coerce_numeric(spark, sf_dir):
    """Values as text, some of them not numbers and some NaN."""
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("n/a "), F.col("value")))
        .when(F.col("event_type") == "signup", F.lit("NaN"))
        .otherwise(F.col("value").cast("string"))
    )
    return X.table(spark, sf_dir, "events").select("event_id", C.to_double(text).alias("number"))


@query(
    "coerce_timestamp",
    "event_id i, event_time_utc t",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END
         AS event_time_utc FROM events""",
)
def coerce_timestamp(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("late "), stamp)).otherwise(stamp)
    return X.table(spark, sf_dir, "events").select(
        "event_id", C.to_timestamp(text).alias("event_time_utc")
    )


@query(
    "epoch_to_ts",
    "event_id i, event_time_utc t",
    "SELECT event_id, date_trunc('second', ts) AS event_time_utc FROM events",
)
def epoch_to_ts(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return X.table(spark, sf_dir, "events").select(
        "event_id", C.epoch_to_timestamp(seconds).alias("event_time_utc")
    )


@query(
    "calendar_fields",
    "event_id i, hour_utc i, day_of_week i, is_weekend b, year i, month i, valid_date s",
    """SELECT event_id, hour(ts) AS hour_utc, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend,
         year(ts) AS year, month(ts) AS month, strftime(ts, '%Y-%m-%d') AS valid_date FROM events""",
)
def calendar_fields(spark, sf_dir):
    fields = C.calendar_fields("ts")
    return X.table(spark, sf_dir, "events").select(
        "event_id", *[column.alias(name) for name, column in fields.items()]
    )


MAPPED = {"l_quantity": ("DE_LU", "load_profile"), "l_extendedprice": ("FR", "price_day_ahead"),
          "l_tax": ("AT", "solar_generation_actual")}


def mapping_frame(spark):
    rows = [(c, *rm) for c, rm in MAPPED.items()]
    return spark.createDataFrame(rows, "column string, region string, metric string")


MAPPED_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_shipdate, l_linenumber, '{c}' AS source_column,"
    f" '{MAPPED.get(c, ('UNKNOWN', c))[0]}' AS region, '{MAPPED.get(c, ('UNKNOWN', c))[1]}' AS metric,"
    f" '{'fraction' if 'profile' in MAPPED.get(c, ('', c))[1] else 'EUR/MWh' if 'price' in MAPPED.get(c, ('', c))[1] else 'MW'}' AS unit,"
    f" {c} AS value FROM lineitem"
    for c in WIDE_VALUES
)


@query(
    "map_dimensions",
    "l_orderkey i, source_column s, region s, metric s, unit s, value d",
    MAPPED_SQL,
)
def map_dimensions(spark, sf_dir):
    long = reshape.melt(X.table(spark, sf_dir, "lineitem"), ["l_orderkey"], WIDE_VALUES)
    return reshape.map_dimensions(long, mapping_frame(spark))


@query(
    "infer_unit",
    "p_partkey i, unit s",
    """SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'fraction'
         WHEN lower(p_type) LIKE '%steel%' THEN 'EUR/MWh' ELSE 'MW' END AS unit FROM part""",
)
def infer_unit(spark, sf_dir):
    """Part types stand in for metric names: brass a profile, steel a price."""
    name = F.replace(F.lower("p_type"), F.lit("brass"), F.lit("Wind Profile"))
    name = F.replace(name, F.lit("steel"), F.lit("Day-Ahead Price"))
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", C.unit_of_metric(name).alias("unit")
    )


@query(
    "normalize_name",
    "p_partkey i, name s, actual s",
    r"""SELECT p_partkey, n AS name, concat('actual_', n) AS actual FROM (SELECT p_partkey,
          trim(regexp_replace(replace(lower(concat('  ', p_type, ' & ', p_name, '#')), '&', 'and'),
            '[^a-z0-9]+', '_', 'g'), '_') AS n FROM part)""",
)
def normalize_name(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_type", F.lit(" & "), "p_name", F.lit("#"))
    return X.table(spark, sf_dir, "part").select(
        "p_partkey",
        C.normalized_name(raw).alias("name"),
        C.normalized_name(raw, "actual_").alias("actual"),
    )


@query(
    "lineage_columns",
    "source s, silver_batch_id s, created_at_utc s, rows i",
    """SELECT 'opsd' AS source, 'b1' AS silver_batch_id,
         '2024-02-01T00:00:00+00:00' AS created_at_utc, count(*) AS rows
       FROM zone_panel WHERE region = 'DE_LU'""",
    "zone_panel",
)
def lineage_columns(spark, sf_dir):
    return (
        X.energy_research(spark, sf_dir)
        .groupBy("source", "silver_batch_id", "created_at_utc")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "forecast_horizon",
    "o_orderkey i, l_linenumber i, horizon d",
    """SELECT o_orderkey, l_linenumber,
         (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0 AS horizon
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def forecast_horizon(spark, sf_dir):
    """Order time as the run, ship time as the valid time; both signs occur."""
    items = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        "o_orderkey", "l_linenumber", C.horizon_hours("o_orderdate", "l_shipdate").alias("horizon")
    )


@query(
    "horizon_bins",
    "event_id i, horizon d, bin_start d0, bin_label s",
    """SELECT event_id, horizon, CAST(floor(horizon / 24) * 24 AS BIGINT) AS bin_start,
         CASE WHEN horizon IS NULL THEN 'unknown' ELSE
           concat(CAST(floor(horizon / 24) * 24 AS BIGINT), '-', CAST(floor(horizon / 24) * 24 + 23 AS BIGINT), 'h')
         END AS bin_label
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value - 60 END AS horizon FROM events)""",
)
def horizon_bins(spark, sf_dir):
    """Horizons with negative and null values."""
    horizon = F.when(F.col("event_type") != "error", F.col("value") - 60)
    start = C.horizon_bin_start("horizon")
    return (
        X.table(spark, sf_dir, "events")
        .select("event_id", horizon.alias("horizon"))
        .withColumn("bin_start", start)
        .withColumn("bin_label", C.horizon_bin_label("bin_start"))
    )


_ERROR_COLUMNS = ", ".join(f"{c} d" for c in K.WEATHER_ERRORS)


@query(
    "forecast_errors",
    f"forecast_run_utc t, valid_time_utc t, location s, {_ERROR_COLUMNS}",
    "SELECT * FROM errors",
    "errors",
)
def forecast_errors(spark, sf_dir):
    return X.forecast_errors(spark, sf_dir)


@query(
    "guarded_ratio",
    "region s, event_time_utc t, renewable_generation_mw d, renewable_share d, load_forecast_error_mw d, load_forecast_error_pct d",
    "SELECT * FROM zone_panel",
    "zone_panel",
)
def guarded_ratio(spark, sf_dir):
    return X.zone_panel(spark, sf_dir)


@query(
    "threshold_flags",
    "region s, event_time_utc t, negative_price_flag b, price_spike_flag b",
    "SELECT * FROM zone_panel",
    "zone_panel",
)
def threshold_flags(spark, sf_dir):
    return X.zone_panel(spark, sf_dir)


@query(
    "filled_flags",
    "event_time_utc t, rain_flag b, heavy_rain_flag b, high_wind_flag b, cold_weather_flag b, weather_complete_flag b",
    """SELECT event_time_utc, coalesce(weather_location_count = 2, false) AS weather_complete_flag,
         coalesce(precipitation_mm_mean, 0) > 0 AS rain_flag,
         coalesce(precipitation_mm_max, 0) >= 5 AS heavy_rain_flag,
         coalesce(wind_speed_10m_kmh_max, 0) >= 30 AS high_wind_flag,
         coalesce(temperature_2m_c_mean, 99) < 0 AS cold_weather_flag FROM weather_hours""",
    "weather_hours",
)
def filled_flags(spark, sf_dir):
    return marts.weather_flags(weather_by_hour(X.actual_weather(spark, sf_dir)))


_METRIC_COLUMNS = ", ".join(f"{m} d" for m in K.MARKET_METRICS)


@query(
    "pivot_fixed_columns",
    f"bzn s, valid_time_utc t, {_METRIC_COLUMNS}",
    "SELECT * FROM hourly",
    "hourly",
)
def pivot_fixed_columns(spark, sf_dir):
    """Every metric has a column, also one no zone reports."""
    return X.market_hourly(spark, sf_dir)


@query(
    "availability_proxy",
    "forecast_run_utc t, rows i, violations i",
    """SELECT forecast_run_utc, count(*) AS rows,
         count(*) FILTER (NOT forecast_availability_proxy) AS violations FROM impact GROUP BY ALL""",
    "impact",
)
def availability_proxy(spark, sf_dir):
    panel = X.impact_panel(spark, sf_dir)
    return panel.groupBy("forecast_run_utc").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("forecast_availability_proxy")).alias("violations"),
    )


_MODEL_COLUMNS = ["price_day_ahead_eur_mwh", "renewable_share", "load_forecast_error_mw"]


@query(
    "listwise_deletion",
    "region s, event_time_utc t, price_day_ahead_eur_mwh d, renewable_share d, load_forecast_error_mw d",
    "SELECT * FROM zone_panel WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _MODEL_COLUMNS),
    "zone_panel",
)
def listwise_deletion(spark, sf_dir):
    return X.zone_panel(spark, sf_dir).dropna(subset=_MODEL_COLUMNS)


@query(
    "zone_metric_fallback",
    "region s, event_time_utc t, wind_generation_mw d, wind_source_metric s",
    "SELECT * FROM zone_panel",
    "zone_panel",
)
def zone_metric_fallback(spark, sf_dir):
    return X.zone_panel(spark, sf_dir)


_STRICT = [K.PRICE, K.LOAD_ACTUAL, K.WIND]


@query(
    "pivot_strict",
    "region s, event_time_utc t, " + ", ".join(f"{m} d" for m in _STRICT),
    "SELECT region, event_time_utc, "
    + ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in _STRICT)
    + " FROM research WHERE metric IN ("
    + ", ".join(f"'{m}'" for m in _STRICT)
    + ") GROUP BY ALL",
    "research",
)
def pivot_strict(spark, sf_dir):
    return reshape.pivot_metrics(
        X.research_long(spark, sf_dir), ["region", "event_time_utc"], _STRICT, how="strict"
    )


@query(
    "pivot_every_hour",
    "region s, event_time_utc t, " + ", ".join(f"{m} d" for m in _STRICT),
    "SELECT region, event_time_utc, "
    + ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in _STRICT)
    + " FROM research GROUP BY ALL",
    "research",
)
def pivot_every_hour(spark, sf_dir):
    """Hours that hold other metrics only stay, with nulls."""
    return reshape.pivot_metrics(
        X.research_long(spark, sf_dir), ["region", "event_time_utc"], _STRICT, how="strict", every_key=True
    )


@query(
    "zone_location_map",
    "bzn s, location s, rows i",
    """SELECT bzn, CASE bzn WHEN 'DE-LU' THEN 'luxembourg' WHEN 'FR' THEN 'paris' ELSE 'vienna' END AS location,
         count(*) AS rows FROM market GROUP BY ALL""",
    "market",
)
def zone_location_map(spark, sf_dir):
    mapping = joins.zone_location_map(spark, K.ZONE_LOCATION, ["DE-LU=luxembourg"])
    return (
        X.market_observations(spark, sf_dir)
        .join(mapping, "bzn")
        .groupBy("bzn", "location")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "union_sources",
    "source s, key i, amount d, note s",
    """SELECT 'orders' AS source, o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS note FROM orders
       UNION ALL SELECT 'customer', c_custkey, c_acctbal, NULL FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_sources(spark, sf_dir):
    def part(name, key, amount, *extra):
        return X.table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), F.col(key).alias("key"), F.col(amount).alias("amount"), *extra
        )

    return reshape.union_sources(
        [
            part("orders", "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("note")),
            part("customer", "c_custkey", "c_acctbal"),
            part("supplier", "s_suppkey", "s_acctbal"),
        ]
    )


@query(
    "sorted_output",
    "bzn s, valid_time_utc t, price_day_ahead d",
    "SELECT bzn, valid_time_utc, price_day_ahead FROM hourly",
    "hourly",
)
def sorted_output(spark, sf_dir):
    return X.market_hourly(spark, sf_dir).orderBy("bzn", "valid_time_utc")
