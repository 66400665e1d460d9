"""Sources and sinks. Files are written by Spark from the given tables first."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import constants as K
from panelspark.operators.aggregates import error_metrics
from panelspark.operators.guards import equal_length
from panelspark.operators.reshape import pivot_metrics
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.plans.registered.spec import query
from panelspark.session import materialize, scratch_path
from panelspark.sources import files, payloads, runs, sinks
from panelspark.streaming.incremental import read_silver, stream_bronze_to_silver

WIDE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a wide CSV delivery, read back as text columns."""
    path = scratch_path(spark, "wide-csv")
    items = X.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("utc_timestamp"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cet_cest_timestamp"),
        *WIDE_VALUES,
    )
    items.write.option("header", True).csv(path)
    return files.read_wide_csv(spark, path, [*files.TIME_COLUMNS, *WIDE_VALUES])


@query(
    "scan_wide_csv",
    "utc_timestamp t, cet_cest_timestamp s, l_quantity d, l_extendedprice d, l_discount d, l_tax d",
    """SELECT l_shipdate AS utc_timestamp,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS cet_cest_timestamp,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
)
def scan_wide_csv(spark, sf_dir):
    return wide_csv(spark, sf_dir)


def _daily_arrays(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """(keys, day, rows): at most 24 hourly rows per key and day, in order."""
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.array_sort(F.collect_list(F.struct(time, *values))).alias("rows")
    )


def _series(name: str) -> Column:
    return F.transform("rows", lambda r: r[name]).alias(name)


def _texts(name: str) -> Column:
    return F.transform("rows", lambda r: F.date_format(r[name], "yyyy-MM-dd'T'HH:mm"))


def _epochs(name: str) -> Column:
    return F.transform("rows", lambda r: F.unix_timestamp(r[name]))


def weather_payloads(spark: SparkSession, sf_dir: str) -> str:
    """Observed-weather payloads per location and day."""
    weather = X.actual_weather(spark, sf_dir).withColumn("weather_code", F.lit(0.0))
    fields = {source: column for source, column in K.OBSERVED_FIELDS.items()}
    daily = _daily_arrays(weather, ["location"], "event_time_utc", list(fields.values()))
    hourly = F.struct(
        _texts("event_time_utc").alias("time"),
        *[_series(column).alias(source) for source, column in fields.items()],
    )
    path = scratch_path(spark, "weather-json")
    daily.select("location", hourly.alias("hourly")).write.partitionBy("location").json(path)
    return path


@query(
    "scan_weather_json",
    "location s, event_time_utc t, temperature_2m_c d, relative_humidity_2m_pct d, "
    "precipitation_mm d, wind_speed_10m_kmh d, shortwave_radiation_w_m2 d, weather_code d",
    "SELECT *, 0.0 AS weather_code FROM weather",
    "weather",
)
def scan_weather_json(spark, sf_dir):
    path = weather_payloads(spark, sf_dir)
    return payloads.read_weather(spark, path, path, one_per_file=False)


def forecast_payloads(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Forecast payloads per run, location and day, and their sidecars."""
    vintages = X.forecast_vintages(spark, sf_dir).withColumn(
        "run", F.date_format("forecast_run_utc", "yyyy-MM-dd'T'HH-mm'Z'")
    )
    daily = _daily_arrays(
        vintages, ["run", "location"], "valid_time_utc", list(K.FORECAST_FIELDS.values())
    )
    hourly = F.struct(
        _texts("valid_time_utc").alias("time"),
        *[_series(column).alias(source) for source, column in K.FORECAST_FIELDS.items()],
    )
    path, requests = scratch_path(spark, "runs-json"), scratch_path(spark, "requests-json")
    daily.select("run", "location", hourly.alias("hourly")).write.partitionBy(
        "location"
    ).json(path)
    vintages.select(
        "run",
        "location",
        "latitude",
        "longitude",
        "model",
        F.date_format("forecast_run_utc", "yyyy-MM-dd'T'HH:mm'Z'").alias("forecast_run_utc"),
    ).distinct().write.json(requests)
    return path, requests


def _vintage_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, sidecars = forecast_payloads(spark, sf_dir)
    rows = payloads.read_forecast_runs(spark, path, path, one_per_file=False)
    requests = payloads.read_requests(spark, sidecars, one_per_file=False)
    return payloads.forecast_silver(rows, requests, "b1")


@query(
    "scan_vintage_json",
    "forecast_run_utc t, location s, rows i, valid_start_utc t, valid_end_utc t, "
    "horizon_min_hours d, horizon_max_hours d",
    """SELECT forecast_run_utc, location, count(*) AS rows, min(valid_time_utc) AS valid_start_utc,
         max(valid_time_utc) AS valid_end_utc, min(forecast_horizon_hours) AS horizon_min_hours,
         max(forecast_horizon_hours) AS horizon_max_hours FROM vintages GROUP BY ALL""",
    "vintages",
)
def scan_vintage_json(spark, sf_dir):
    return _vintage_silver(spark, sf_dir).groupBy("forecast_run_utc", "location").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("valid_time_utc").alias("valid_start_utc"),
        F.max("valid_time_utc").alias("valid_end_utc"),
        F.min("forecast_horizon_hours").alias("horizon_min_hours"),
        F.max("forecast_horizon_hours").alias("horizon_max_hours"),
    )


@query(
    "scan_vintage_panel_json",
    "forecast_run_utc t, valid_time_utc t, forecast_horizon_hours d, location s, "
    "temperature_forecast_c d, wind_speed_forecast_kmh d, "
    "shortwave_radiation_forecast_w_m2 d, precipitation_forecast_mm d",
    "SELECT * FROM vintages",
    "vintages",
)
def scan_vintage_panel_json(spark, sf_dir):
    return _vintage_silver(spark, sf_dir)


# Series name in a power payload -> hourly metric behind it.
POWER_SERIES = {
    "Load": "actual_load",
    "Solar": "actual_solar",
    "Wind onshore": "actual_wind_onshore",
    "Renewable share of load": "actual_renewable_share_of_load",
    "Residual load": "actual_residual_load",
}
FORECAST_SERIES = {
    "load": "forecast_load",
    "solar": "forecast_solar",
    "wind_onshore": "forecast_wind_onshore",
}


def _hourly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = X.market_observations(spark, sf_dir).withColumn(
        "valid_time_utc", F.date_trunc("hour", "event_time_utc")
    )
    return pivot_metrics(observations, ["bzn", "valid_time_utc"], K.MARKET_METRICS)


def market_payloads(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Price, power and power-forecast payloads per zone and day."""
    used = ["price_day_ahead", *POWER_SERIES.values(), *FORECAST_SERIES.values()]
    daily = materialize(
        _daily_arrays(_hourly_means(spark, sf_dir), ["bzn"], "valid_time_utc", used), "daily"
    )
    keys = [
        "bzn",
        F.lit("xx").alias("country"),
        F.lit("b1").alias("batch_id"),
        _epochs("valid_time_utc").alias("unix_seconds"),
    ]
    paths = {n: scratch_path(spark, f"{n}-json") for n in ("price", "power", "forecast")}
    daily.select(*keys, _series("price_day_ahead").alias("price")).write.partitionBy(
        "country", "bzn"
    ).json(paths["price"])
    series = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _series(metric).alias("data"))
            for name, metric in POWER_SERIES.items()
        ]
    )
    daily.select(*keys, series.alias("production_types")).write.partitionBy(
        "country", "bzn"
    ).json(paths["power"])
    kinds = F.array(
        *[
            F.struct(F.lit(name).alias("production_type"), _series(metric).alias("forecast_values"))
            for name, metric in FORECAST_SERIES.items()
        ]
    )
    daily.select(*keys, F.explode(kinds).alias("k")).select(
        "bzn", "country", "batch_id", "unix_seconds", "k.*", F.lit("day-ahead").alias("forecast_type")
    ).write.partitionBy("country", "bzn").json(paths["forecast"])
    return paths


_MARKET_COLUMNS = (
    "bzn s, event_time_utc t, source_timestamp_s i, metric s, value d, unit s, series_type s, "
    "production_type s, source_endpoint s"
)


def _market_long_sql(metrics: list[tuple[str, str, str, str | None, str]]) -> str:
    parts = [
        f"SELECT bzn, valid_time_utc AS event_time_utc,"
        f" CAST(epoch(valid_time_utc) AS BIGINT) AS source_timestamp_s, '{metric}' AS metric,"
        f" {source} AS value, '{unit}' AS unit, '{kind}' AS series_type,"
        f" {'NULL' if name is None else repr(name)} AS production_type,"
        f" '{endpoint}' AS source_endpoint FROM hourly"
        for source, metric, unit, name, kind, endpoint in metrics
    ]
    return " UNION ALL ".join(parts)


def _power_unit(name: str) -> str:
    return "pct" if "share" in name.lower() else "MW"


PRICE_SQL = _market_long_sql(
    [("price_day_ahead", "price_day_ahead", "EUR / MWh", None, "market_outcome", "/price")]
)
POWER_SQL = _market_long_sql(
    [
        (m, f"actual_{n.lower().replace(' ', '_')}", _power_unit(n), n, "actual", "/public_power")
        for n, m in POWER_SERIES.items()
    ]
)
POWER_FORECAST_SQL = _market_long_sql(
    [
        (m, f"forecast_{n}", "MW", n, "forecast", "/public_power_forecast")
        for n, m in FORECAST_SERIES.items()
    ]
)


@query("scan_price_json", _MARKET_COLUMNS, PRICE_SQL, "hourly")
def scan_price_json(spark, sf_dir):
    path = market_payloads(spark, sf_dir)["price"]
    return payloads.read_prices(spark, path, path, one_per_file=False)


@query("scan_power_json", _MARKET_COLUMNS, POWER_SQL, "hourly")
def scan_power_json(spark, sf_dir):
    path = market_payloads(spark, sf_dir)["power"]
    return payloads.read_public_power(spark, path, path, one_per_file=False)


@query("scan_power_forecast_json", _MARKET_COLUMNS, POWER_FORECAST_SQL, "hourly")
def scan_power_forecast_json(spark, sf_dir):
    path = market_payloads(spark, sf_dir)["forecast"]
    return payloads.read_power_forecasts(spark, path, path, one_per_file=False)


def market_silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = market_payloads(spark, sf_dir)
    return payloads.market_rows(
        payloads.read_prices(spark, paths["price"], paths["price"], one_per_file=False),
        payloads.read_public_power(spark, paths["power"], paths["power"], one_per_file=False),
        payloads.read_power_forecasts(
            spark, paths["forecast"], paths["forecast"], one_per_file=False
        ),
    )


@query(
    "array_length_guard",
    "bzn s, payloads i, positions i",
    """SELECT bzn, count(DISTINCT CAST(valid_time_utc AS DATE)) AS payloads, count(*) AS positions
       FROM hourly GROUP BY bzn""",
    "hourly",
)
def array_length_guard(spark, sf_dir):
    """Times and prices per payload; a length mismatch would raise."""
    daily = _daily_arrays(
        _hourly_means(spark, sf_dir), ["bzn"], "valid_time_utc", ["price_day_ahead"]
    )
    arrays = daily.select(
        "bzn", _epochs("valid_time_utc").alias("seconds"), _series("price_day_ahead").alias("price")
    )
    checked = arrays.withColumn(
        "price", equal_length(F.col("price"), F.col("seconds"), F.lit("price"))
    )
    return checked.groupBy("bzn").agg(
        F.count(F.lit(1)).alias("payloads"), F.sum(F.size("price")).alias("positions")
    )


def _coordinate(index: int) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {xy[index]}" for n, xy in K.LOCATION_COORDINATES.items())
    return f"CASE location {cases} END"


@query(
    "sidecar_join",
    "location s, event_time_utc t, latitude d, longitude d, temperature_2m_c d",
    f"""SELECT location, event_time_utc, {_coordinate(0)} AS latitude,
          {_coordinate(1)} AS longitude, temperature_2m_c FROM weather""",
    "weather",
)
def sidecar_join(spark, sf_dir):
    weather = X.actual_weather(spark, sf_dir)
    return payloads.join_sidecar(weather, marts.location_frame(spark), ["location"])


@query(
    "column_mapping",
    "column s, region s, metric s",
    """SELECT concat('c', p_partkey) AS "column", p_brand AS region, p_type AS metric FROM part""",
)
def column_mapping(spark, sf_dir):
    """Package metadata with one field per part, read back as a mapping."""
    path = scratch_path(spark, "package-json")
    properties = F.struct(F.col("p_brand").alias("Region"), F.col("p_type").alias("Variable"))
    one = F.struct(
        F.concat(F.lit("c"), "p_partkey").alias("name"), properties.alias("opsdProperties")
    )
    other = F.struct(
        F.lit("utc_timestamp").alias("name"),
        F.struct(
            F.lit(None).cast("string").alias("Region"), F.lit("").alias("Variable")
        ).alias("opsdProperties"),
    )
    schema = F.struct(F.array(one, other).alias("fields"))
    parts = X.table(spark, sf_dir, "part")
    parts.select(F.array(F.struct(schema.alias("schema"))).alias("resources")).write.json(path)
    return files.read_column_mapping(spark, path, one_per_file=False)


def market_lake(spark: SparkSession, sf_dir: str) -> str:
    """Market observations as a Hive-partitioned Silver table."""
    path = scratch_path(spark, "market-silver")
    observations = X.market_observations(spark, sf_dir).withColumns(
        {
            "year": F.year("event_time_utc"),
            "month": F.month("event_time_utc"),
        }
    )
    return sinks.write_batch(observations, path, ["year", "month", "bzn"])


@query(
    "scan_partitioned",
    "bzn s, year s, month s, metric s, rows i, total d3",
    """SELECT bzn, year(event_time_utc) AS year, month(event_time_utc) AS month, metric,
         count(*) AS rows, sum(value) AS total FROM market GROUP BY ALL""",
    "market",
)
def scan_partitioned(spark, sf_dir):
    lake = files.read_lake_table(spark, market_lake(spark, sf_dir))
    return lake.groupBy("bzn", "year", "month", "metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")
    )


@query(
    "scan_projected",
    "event_id i, value d",
    "SELECT event_id, value FROM events",
)
def scan_projected(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", "value")


@query(
    "scan_filtered",
    "event_id i, event_type s, value d",
    "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'view')",
)
def scan_filtered(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    return events.where(F.col("event_type").isin("purchase", "view"))


def batched_events(spark: SparkSession, sf_dir: str) -> str:
    """Events as one immutable batch per day."""
    path = scratch_path(spark, "batches")
    events = X.table(spark, sf_dir, "events").withColumns(
        {
            "ingestion_date": F.date_format("ts", "yyyyMMdd"),
            "batch_id": F.date_format("ts", "yyyyMMdd'T000000Z'"),
        }
    )
    return sinks.write_batch(events, path, ["ingestion_date", "batch_id"])


@query(
    "latest_batch",
    "batch_id s, event_id i, value d",
    """SELECT strftime(ts, '%Y%m%dT000000Z') AS batch_id, event_id, value FROM events
       WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
)
def latest_batch(spark, sf_dir):
    table = files.read_lake_table(spark, batched_events(spark, sf_dir))
    return files.latest_batch(table, ["ingestion_date", "batch_id"])


@query(
    "path_keys",
    "ingestion_date s, batch_id s, run s",
    """SELECT DISTINCT strftime(ts, '%Y%m%d') AS ingestion_date,
         strftime(ts, '%Y%m%dT000000Z') AS batch_id, NULL AS run FROM events""",
)
def path_keys(spark, sf_dir):
    listed = files.list_files(spark, batched_events(spark, sf_dir), "*.parquet")
    keyed = files.path_keys(listed, ["ingestion_date", "batch_id", "run"])
    return keyed.select("ingestion_date", "batch_id", "run").distinct()


@query(
    "tolerant_json",
    "event_id i, k d0",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
         ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def tolerant_json(spark, sf_dir):
    """Every fifth document is cut short, as a broken delivery would be."""
    events = X.table(spark, sf_dir, "events")
    cut = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    documents = events.select("event_id", cut.alias("text")).withColumn(
        "document", files.tolerant_document("text")
    )
    return documents.withColumn("k", F.try_variant_get("document", "$.k", "bigint"))


@query("bronze_manifest", "file_name s, bytes i, sha256 s, source s, batch_id s, status s")
def bronze_manifest(spark, sf_dir):
    return files.bronze_manifest(spark, sf_dir, "driver", "b1", "*.parquet")


_EXPECTED_SQL = " UNION ALL ".join(
    f"SELECT '{z}' AS bzn, '{m}' AS metric, {str(m.startswith('forecast') or 'offshore' in m).lower()} AS optional"
    for z in X.ZONES
    for m in K.MARKET_METRICS
)


@query(
    "series_availability",
    "bzn s, metric s, optional b, status s",
    f"""SELECT e.*, CASE WHEN l.metric IS NULL THEN 'unavailable' ELSE 'available' END AS status
        FROM ({_EXPECTED_SQL}) e LEFT JOIN (SELECT DISTINCT bzn, metric FROM market) l
        USING (bzn, metric)""",
    "market",
)
def series_availability(spark, sf_dir):
    rows = [
        (z, m, m.startswith("forecast") or "offshore" in m)
        for z in X.ZONES
        for m in K.MARKET_METRICS
    ]
    expected = spark.createDataFrame(rows, "bzn string, metric string, optional boolean")
    landed = X.market_observations(spark, sf_dir)
    return files.series_availability(expected, landed, ["bzn", "metric"])


@query(
    "payload_validation",
    "endpoint s, problem s, payloads i",
    """SELECT CASE event_type WHEN 'purchase' THEN '/price' WHEN 'view' THEN '/public_power'
           WHEN 'click' THEN '/public_power_forecast' ELSE '/price' END AS endpoint,
         CASE event_type WHEN 'purchase' THEN NULL
           WHEN 'view' THEN '/public_power response has no production_types'
           WHEN 'click' THEN 'API error: quota' WHEN 'signup' THEN 'not a JSON object'
           ELSE 'not JSON' END AS problem, count(*) AS payloads
       FROM events GROUP BY ALL""",
)
def payload_validation(spark, sf_dir):
    """One payload per event: good, incomplete, refused, a list, and no JSON."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    endpoint = (
        F.when(kind == "view", "/public_power")
        .when(kind == "click", "/public_power_forecast")
        .otherwise("/price")
    )
    body = (
        F.when(kind == "purchase", F.concat(F.lit('{"price": ['), value, F.lit("]}")))
        .when(kind == "view", F.concat(F.lit('{"unix_seconds": ['), value, F.lit("]}")))
        .when(kind == "click", F.lit('{"error": "quota", "forecast_values": []}'))
        .when(kind == "signup", F.concat(F.lit("["), value, F.lit("]")))
        .otherwise(F.concat(F.lit("<html>"), value))
    )
    raw = X.table(spark, sf_dir, "events").select(endpoint.alias("endpoint"), body.alias("body"))
    return (
        payloads.validate_payloads(raw)
        .groupBy("endpoint", "problem")
        .agg(F.count(F.lit(1)).alias("payloads"))
    )


@query(
    "run_catalog",
    "forecast_run_utc t, location s, latitude d, longitude d",
    f"""SELECT run AS forecast_run_utc, location, {_coordinate(0)} AS latitude, {_coordinate(1)} AS longitude
        FROM (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP + INTERVAL 48 HOUR,
                date_trunc('day', max(ts))::TIMESTAMP - INTERVAL 216 HOUR, INTERVAL 12 HOUR)) AS run
              FROM events)
        CROSS JOIN (SELECT unnest(['frankfurt', 'paris', 'vienna']) AS location)""",
)
def run_catalog(spark, sf_dir):
    return runs.runs_between(X.run_bounds(spark, sf_dir), 12, X.LOCATIONS)


@query(
    "write_partitioned",
    "region s, event_time_utc t, load_actual_mw d, wind_generation_mw d, year s, month s",
    "SELECT * FROM zone_panel",
    "zone_panel",
)
def write_partitioned(spark, sf_dir):
    path = scratch_path(spark, "zone-panel")
    keys = sinks.LAYOUTS["gold/multi_zone_panel"]
    sinks.write_batch(X.zone_panel(spark, sf_dir), path, keys)
    return files.read_lake_table(spark, path)


@query(
    "write_once",
    "outcome s, rows i",
    """SELECT unnest(['published', 'refused']) AS outcome, (SELECT count(*) FROM events) AS rows""",
)
def write_once(spark, sf_dir):
    """The first write publishes; the second is refused and changes nothing."""
    path = scratch_path(spark, "write-once")
    events = X.table(spark, sf_dir, "events").withColumn("month", F.month("ts"))
    sinks.write_batch(events, path, ["month"])
    try:
        sinks.write_batch(events, path, ["month"])
        second = "overwritten"
    except AnalysisException:
        second = "refused"
    outcomes = F.explode(F.array(F.lit("published"), F.lit(second)))
    stored = files.read_lake_table(spark, path)
    return stored.agg(F.count(F.lit(1)).alias("rows")).select(outcomes.alias("outcome"), "rows")


# contracts of the two publish attempts: (name, rules over the observed metrics)
_PUBLISH_ATTEMPTS = [
    ("complete", {"has rows": lambda m: m["rows"] > 0, "no null value": lambda m: m["null_values"] == 0}),
    ("bounded", {"values at most 100": lambda m: m["max_value"] is not None and m["max_value"] <= 100}),
]


@query(
    "publish_checked",
    "attempt s, outcome s, rows_observed i, rows_readable i",
    """SELECT 'complete' AS attempt,
         CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE value IS NULL) = 0 THEN 'published' ELSE 'rejected' END AS outcome,
         count(*) AS rows_observed,
         CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE value IS NULL) = 0 THEN count(*) ELSE 0 END AS rows_readable
       FROM events
       UNION ALL
       SELECT 'bounded', CASE WHEN max(value) <= 100 THEN 'published' ELSE 'rejected' END, count(*),
         CASE WHEN max(value) <= 100 THEN count(*) ELSE 0 END FROM events""",
)
def publish_checked(spark, sf_dir):
    """Each attempt stages, observes its metrics in the same write, and publishes only if its rules hold."""
    events = X.table(spark, sf_dir, "events").withColumn("month", F.month("ts"))
    metrics = {
        "null_values": F.count_if(F.col("value").isNull()),
        "max_value": F.max("value"),
    }
    rows = []
    for attempt, rules in _PUBLISH_ATTEMPTS:
        path = scratch_path(spark, f"publish-{attempt}")
        try:
            found = sinks.publish(events, path, ["month"], metrics, rules)
            outcome = "published"
        except sinks.RejectedBatch as rejected:
            found, outcome = rejected.metrics, "rejected"
        try:
            readable = sinks.read_published(spark, path).count()
        except FileNotFoundError:
            readable = 0
        rows.append((attempt, outcome, int(found["rows"]), readable))
    return spark.createDataFrame(rows, "attempt string, outcome string, rows_observed long, rows_readable long")


def overall_sql(keys: str = "") -> str:
    prefix = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {prefix}'{v}' AS variable, '{K.VARIABLE_LABELS[v]}' AS variable_label,"
        f" count({v}_error) AS n, avg({v}_error) AS bias_forecast_minus_actual,"
        f" avg(abs({v}_error)) AS mae, sqrt(avg({v}_error * {v}_error)) AS rmse,"
        f" max(abs({v}_error)) AS max_absolute_error FROM errors"
        + (f" GROUP BY {keys}" if keys else "")
        for v in K.WEATHER_VARIABLES
    )


@query(
    "write_metrics",
    "format s, variable s, n i, mae d, rmse d",
    f"""SELECT f.format, m.* FROM ({overall_sql()}) m
        CROSS JOIN (SELECT unnest(['parquet', 'csv']) AS format) f""",
    "errors",
)
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    metrics = error_metrics(X.forecast_errors(spark, sf_dir))
    sinks.write_metrics(metrics.coalesce(1), path)
    stored = spark.read.parquet(f"{path}/parquet").withColumn("format", F.lit("parquet"))
    text = spark.read.schema(metrics.schema).option("header", True).csv(f"{path}/csv")
    return stored.unionByName(text.withColumn("format", F.lit("csv")))


@query(
    "batch_report",
    "rows_gold i, market_matched_rows i, market_unmatched_rows i, market_match_rate d, "
    "availability_proxy_violations i, weather_location_complete_rate d",
    """SELECT count(*) AS rows_gold, count(*) FILTER (market_match_flag) AS market_matched_rows,
         count(*) FILTER (NOT market_match_flag) AS market_unmatched_rows,
         avg(market_match_flag::INT) AS market_match_rate,
         count(*) FILTER (NOT forecast_availability_proxy) AS availability_proxy_violations,
         avg(weather_location_complete::INT) AS weather_location_complete_rate FROM impact""",
    "impact",
)
def batch_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = marts.impact_report(X.impact_panel(spark, sf_dir))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "stream_bronze_to_silver",
    "bzn s, metric s, rows i, total d3",
    """SELECT bzn, metric, count(*) AS rows, sum(value) AS total FROM (
         SELECT DISTINCT bzn, metric, event_time_utc, value FROM market) GROUP BY ALL""",
    "market",
)
def stream_silver(spark, sf_dir):
    """Deliveries land twice; the stream keeps one row per Silver key."""
    landing = scratch_path(spark, "landing")
    rows = X.market_observations(spark, sf_dir).withColumn(
        "event_time_utc", F.col("event_time_utc").cast("timestamp")
    )
    rows.write.parquet(f"{landing}/first")
    rows.write.parquet(f"{landing}/second")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    silver = scratch_path(spark, "stream-silver")
    done = stream_bronze_to_silver(
        spark, f"{landing}/*", silver, scratch_path(spark, "stream-checkpoint"), schema,
    )
    done.awaitTermination()
    return read_silver(spark, silver).groupBy("bzn", "metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")
    )


@query(
    "stream_late_keys",
    "bzn s, metric s, rows i, total d3",
    """SELECT bzn, metric, count(*) AS rows, sum(value) AS total FROM (
         SELECT DISTINCT bzn, metric, event_time_utc, value FROM market) GROUP BY ALL""",
    "market",
)
def stream_late_keys(spark, sf_dir):
    """The later half lands first; the earlier half and repeats come in a second run."""
    landing, silver = scratch_path(spark, "landing"), scratch_path(spark, "stream-silver")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    rows = X.market_observations(spark, sf_dir).withColumn(
        "event_time_utc", F.col("event_time_utc").cast("timestamp")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    middle = rows.agg(F.expr("timestamp_micros((unix_micros(min(event_time_utc)) + unix_micros(max(event_time_utc))) div 2)")).first()[0]
    for delivery in (rows.where(F.col("event_time_utc") >= F.lit(middle)), rows):
        delivery.write.mode("append").parquet(landing)
        stream_bronze_to_silver(spark, landing, silver, checkpoint, schema).awaitTermination()
    return read_silver(spark, silver).groupBy("bzn", "metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")
    )


@query(
    "payload_quarantine",
    "event_type s, problem s",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 'not JSON' WHEN 'error' THEN concat('API error: ', count(*))
         WHEN 'purchase' THEN '/price response has no price' ELSE 'not a JSON object' END AS problem
       FROM events WHERE event_type <> 'view' GROUP BY event_type""",
)
def payload_quarantine(spark, sf_dir):
    """One document per file: a good one, a cut one, an error, one without its key, a list."""
    landing = scratch_path(spark, "landing")
    n, low, high = (F.col(c).cast("string") for c in ("n", "low", "high"))
    good = F.concat(F.lit('{"unix_seconds": [1, 2], "price": ['), low, F.lit(", "), high, F.lit("]}"))
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", good)
        .when(kind == "click", F.substring(good, 1, 30))
        .when(kind == "error", F.concat(F.lit('{"error": "'), n, F.lit('"}')))
        .when(kind == "purchase", F.lit('{"unix_seconds": [1]}'))
        .otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )
    sums = X.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    sums.select("event_type", body.alias("value")).write.partitionBy("event_type").text(landing)
    refused = payloads.quarantined(spark, landing, F.lit("/price"))
    return refused.select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type"), "problem")
