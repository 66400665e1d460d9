"""JSON deliveries with parallel arrays, one row per array position.

Every reader takes a folder (or glob) and returns typed rows. Path keys such
as ``location=`` become columns through partition discovery. One reader call
covers any number of files; nothing is read per file on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import FORECAST_FIELDS, OBSERVED_FIELDS
from panelspark.functions.columns import (
    epoch_to_timestamp,
    horizon_hours,
    normalized_name,
    to_double,
    to_timestamp,
    unit_of_power_series,
)
from panelspark.operators.guards import equal_length
from panelspark.operators.reshape import union_sources

REQUEST_SCHEMA = (
    "location string, latitude double, longitude double, forecast_run_utc string, "
    "model string, forecast_days int, retrieved_at_utc string"
)
PRICE_SCHEMA = "unix_seconds array<bigint>, price array<double>, unit string"
POWER_SCHEMA = (
    "unix_seconds array<bigint>, "
    "production_types array<struct<name: string, data: array<double>>>"
)
FORECAST_SCHEMA = (
    "unix_seconds array<bigint>, forecast_values array<double>, "
    "production_type string, forecast_type string"
)


def read_documents(
    spark: SparkSession, path: str, schema: str, base: str | None = None,
    one_per_file: bool = True, pattern: str | None = None,
) -> DataFrame:
    """JSON documents under ``path``; path keys below ``base`` become columns.

    A document that is cut, no object, or holds an error stops the read: a
    delivery is never lost in silence. ``quarantined`` lists such documents
    without stopping.
    """
    reader = spark.read.schema(f"{schema}, {_JUDGED}").option("multiLine", str(one_per_file).lower())
    reader = reader.option("columnNameOfCorruptRecord", "_broken")
    if base:
        reader = reader.option("basePath", base)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    documents = reader.json(path)
    where = F.concat(F.lit("unusable payload in "), F.col("_metadata.file_path"), F.lit(": "))
    reported = F.col("error").isNotNull() & ~F.lower("error").isin("", "false", "0", "null")
    guard = (
        F.when(F.col("_broken").isNotNull(), F.raise_error(F.concat(where, F.lit("not a JSON object"))))
        .when(reported, F.raise_error(F.concat(where, F.lit("error "), F.col("error"))))
        .cast("string")
    )
    # the guard sits on a required column, so no projection can prune it away
    first = documents.columns[0]
    checked = F.when(guard.isNull(), F.col(first))
    return documents.withColumn(first, checked).drop("_broken", "error")


_JUDGED = "error string, _broken string"


def quarantined(spark: SparkSession, path: str, endpoint: Column, base: str | None = None) -> DataFrame:
    """(path, endpoint, problem) of the files, one document each, that a reader refuses."""
    reader = spark.read.option("recursiveFileLookup", "true")
    texts = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    _, refused = split_payloads(texts.withColumn("endpoint", endpoint))
    return refused.select("path", "endpoint", "problem")


def required(column: str) -> Column:
    """A field that a payload must have; its absence stops the read."""
    absent = F.raise_error(F.lit(f"a payload has no {column}"))
    return F.coalesce(F.col(column), absent)


def zip_rows(df: DataFrame, arrays: dict[str, Column], keep: list[str | Column]) -> DataFrame:
    """One row per position of parallel arrays, which must have one length."""
    first = next(iter(arrays.values()))
    checked = {
        name: (values if index == 0 else equal_length(values, first, F.lit(name)))
        for index, (name, values) in enumerate(arrays.items())
    }
    zipped = F.arrays_zip(*[c.alias(n) for n, c in checked.items()])
    names = list(arrays)
    exploded = df.select(*keep, F.explode(zipped).alias("_z"))
    fields = [F.col("_z").getField(name).alias(name) for name in names]
    kept = [c for c in exploded.columns if c != "_z"]
    return exploded.select(*kept, *fields)


def _hourly_schema(fields: dict[str, str]) -> str:
    inner = ", ".join(f"{name}: array<string>" for name in fields)
    return f"hourly struct<time: array<string>, {inner}>"


def _hourly_rows(df: DataFrame, fields: dict[str, str], time: str, keep: list) -> DataFrame:
    arrays = {time: F.col("hourly.time")}
    arrays.update({column: F.col(f"hourly.{name}") for name, column in fields.items()})
    rows = zip_rows(df, {**arrays, time: required("hourly.time")}, keep)
    typed = {column: to_double(column) for column in fields.values()}
    return rows.withColumns({time: to_timestamp(time), **typed})


def read_weather(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """Observed weather: location and one row per hour."""
    schema = _hourly_schema(OBSERVED_FIELDS) + ", location string"
    documents = read_documents(spark, path, schema, base, one_per_file)
    return _hourly_rows(documents, OBSERVED_FIELDS, "event_time_utc", ["location"])


def read_forecast_runs(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """Forecast runs: run, location and one row per predicted hour.

    One run or many, one location or many: all are rows of the same scan.
    """
    schema = _hourly_schema(FORECAST_FIELDS) + ", run string, location string"
    documents = read_documents(spark, path, schema, base, one_per_file)
    return _hourly_rows(documents, FORECAST_FIELDS, "valid_time_utc", ["run", "location"])


def read_requests(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """Request sidecars; run and location come from the path when present."""
    return read_documents(
        spark, path, REQUEST_SCHEMA + ", run string", base, one_per_file
    )


def join_sidecar(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates, model and run time of the request that fetched the rows."""
    wanted = ["latitude", "longitude", "model", "forecast_run_utc"]
    side = requests.select(*keys, *[c for c in wanted if c in requests.columns])
    return rows.join(side, keys, "left")


def forecast_silver(rows: DataFrame, requests: DataFrame, batch_id: str) -> DataFrame:
    """Typed vintage rows with the horizon of each predicted hour."""
    joined = join_sidecar(rows, requests, ["run", "location"])
    joined = joined.withColumn("forecast_run_utc", to_timestamp("forecast_run_utc"))
    return joined.select(
        "forecast_run_utc",
        "valid_time_utc",
        horizon_hours("forecast_run_utc", "valid_time_utc").alias("forecast_horizon_hours"),
        "location",
        "latitude",
        "longitude",
        "model",
        *FORECAST_FIELDS.values(),
        F.lit("open_meteo_single_runs").alias("source"),
        F.lit(batch_id).alias("batch_id"),
    )


MARKET_COLUMNS = [
    "source_timestamp_s",
    "event_time_utc",
    "value",
    "metric",
    "series_type",
    "unit",
    "production_type",
    "forecast_type",
    "source_endpoint",
    "source",
    "country",
    "bzn",
    "batch_id",
]


def _market_rows(
    documents: DataFrame, values: Column, metric: Column, series_type: str, unit: Column,
    production: Column, forecast: Column, endpoint: str,
) -> DataFrame:
    keep = [
        metric.alias("metric"),
        F.lit(series_type).alias("series_type"),
        unit.alias("unit"),
        production.cast("string").alias("production_type"),
        forecast.cast("string").alias("forecast_type"),
        F.lit(endpoint).alias("source_endpoint"),
        F.lit("energy_charts_api").alias("source"),
        "country",
        "bzn",
        "batch_id",
    ]
    arrays = {"source_timestamp_s": required("unix_seconds"), "value": values}
    rows = zip_rows(documents, arrays, keep)
    return rows.withColumns(
        {
            "event_time_utc": epoch_to_timestamp("source_timestamp_s"),
            "value": to_double("value"),
        }
    ).select(*MARKET_COLUMNS)


_PATH_KEYS = ", country string, bzn string, batch_id string"


def read_prices(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    documents = read_documents(spark, path, PRICE_SCHEMA + _PATH_KEYS, base, one_per_file)
    return _market_rows(
        documents, required("price"), F.lit("price_day_ahead"), "market_outcome",
        F.coalesce("unit", F.lit("EUR / MWh")), F.lit(None), F.lit(None), "/price",
    )


def read_public_power(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """One array of series sharing the time array; first exploded by series."""
    documents = read_documents(spark, path, POWER_SCHEMA + _PATH_KEYS, base, one_per_file)
    series = documents.select(
        "unix_seconds", "country", "bzn", "batch_id", F.explode(required("production_types")).alias("s")
    )
    return _market_rows(
        series, F.col("s.data"), normalized_name("s.name", "actual_"), "actual",
        unit_of_power_series("s.name"), F.col("s.name"), F.lit(None), "/public_power",
    )


def read_power_forecasts(
    spark: SparkSession, path: str, base: str | None = None, one_per_file: bool = True
) -> DataFrame:
    documents = read_documents(spark, path, FORECAST_SCHEMA + _PATH_KEYS, base, one_per_file)
    return _market_rows(
        documents, required("forecast_values"), normalized_name("production_type", "forecast_"),
        "forecast", F.lit("MW"), F.col("production_type"), F.col("forecast_type"),
        "/public_power_forecast",
    )


def market_rows(*sources: DataFrame) -> DataFrame:
    return union_sources(list(sources))


# Endpoint -> key its payload must have.
REQUIRED_KEY = {
    "/price": "price",
    "/public_power": "production_types",
    "/public_power_forecast": "forecast_values",
}


def validate_payloads(raw: DataFrame, endpoint: str = "endpoint", body: str = "body") -> DataFrame:
    """Adds ``problem``: null for a usable payload, else why it is refused."""
    document = F.try_parse_json(F.col(body))
    is_object = F.schema_of_variant(document).startswith("OBJECT")
    error = F.try_variant_get(document, "$.error", "string")
    problem = (
        F.when(document.isNull(), F.lit("not JSON"))
        .when(~is_object, F.lit("not a JSON object"))
        .when(
            error.isNotNull() & ~error.isin("", "false", "0"),
            F.concat(F.lit("API error: "), error),
        )
    )
    for name, key in REQUIRED_KEY.items():
        absent = F.try_variant_get(document, f"$.{key}", "variant").isNull()
        problem = problem.when(
            (F.col(endpoint) == name) & absent, F.lit(f"{name} response has no {key}")
        )
    return raw.withColumn("problem", problem)


def split_payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine): refused payloads keep the reason they were refused."""
    judged = validate_payloads(raw)
    return judged.where("problem IS NULL").drop("problem"), judged.where("problem IS NOT NULL")
