"""Write-once batch outputs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Partition keys of the lake tables.
LAYOUTS = {
    "silver/opsd_time_series": ["year", "month"],
    "silver/weather_open_meteo": ["year", "month", "location"],
    "silver/weather_forecast_vintage": ["run_date", "valid_year", "valid_month", "location"],
    "silver/energy_charts": ["year", "month", "series_type", "metric"],
    "gold/energy_research": ["year", "month"],
    "gold/multi_zone_panel": ["year", "month", "region"],
    "gold/energy_weather_panel": ["year", "month"],
    "gold/forecast_error": ["run_date", "valid_year", "valid_month", "location"],
    "gold/energy_forecast_impact": ["run_date", "valid_year", "valid_month", "bzn"],
    "gold/multi_zone_forecast_impact": ["bzn", "run_date", "valid_year", "valid_month"],
}


def write_batch(
    df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 5_000_000
) -> str:
    """Write a partitioned Parquet batch; an existing output is refused.

    The rebalance hint gathers the rows of a partition directory into few
    files. Adaptive execution splits a hot directory (a zone or month with a
    third of the rows) over several tasks and merges the small ones.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*keys)
        .parquet(path)
    )
    return path


def write_metrics(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> None:
    """A small metric table in its own folder, once per format."""
    for name in formats:
        writer = df.write.mode("errorifexists")
        target = f"{path}/{name}"
        writer.option("header", True).csv(target) if name == "csv" else writer.format(name).save(
            target
        )


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    report.write.mode("errorifexists").json(path)


def write_checked(df: DataFrame, path: str, keys: Sequence[str], *checks) -> str:
    """Run every check first; publish only when none of them raised."""
    for check in checks:
        check(df)
    return write_batch(df, path, keys)




MARKER = "_PUBLISHED.json"


class RejectedBatch(ValueError):
    """A publish whose checks failed; nothing was made readable."""

    def __init__(self, failed: list[str], metrics: dict):
        super().__init__(f"checks failed: {', '.join(failed)}")
        self.failed, self.metrics = failed, metrics


def publish(
    df: DataFrame, path: str, keys: Sequence[str], metrics: dict, rules: dict, rows_per_file: int = 5_000_000
) -> dict:
    """Write, check and publish a batch in one pass over its rows.

    The rows go to a staging folder beside ``path`` while ``metrics`` (name ->
    aggregate Column) are observed during that same write. ``rules`` (name ->
    predicate over the metrics dict) are then checked without reading the rows
    again. If all hold, the staging folder is renamed to ``path`` and a commit
    marker with the metrics is written last; readers that require the marker
    (``read_published``) see the batch only then. If any rule fails the staging
    folder is deleted and ``RejectedBatch`` is raised. An existing ``path`` is
    refused before anything is written.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    storage = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if storage.exists(target):
        raise FileExistsError(path)
    staging = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}")
    observation = Observation("publish")
    named = [column.alias(name) for name, column in metrics.items()]
    observed = df.observe(observation, F.count(F.lit(1)).alias("rows"), *named)
    try:
        (
            observed.hint("rebalance", *[F.col(k) for k in keys])
            .write.mode("errorifexists")
            .option("maxRecordsPerFile", rows_per_file)
            .partitionBy(*keys)
            .parquet(staging.toString())
        )
        found = _observed(observation, df, [F.count(F.lit(1)).alias("rows"), *named])
        failed = [name for name, rule in rules.items() if not rule(found)]
        if failed:
            raise RejectedBatch(failed, found)
        if not storage.rename(staging, target):
            raise OSError(f"could not move the staged batch to {path}")
    except BaseException:
        storage.delete(staging, True)
        raise
    stream = storage.create(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}"), False)
    stream.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    stream.close()
    return found


def _observed(observation, df: DataFrame, columns: list) -> dict:
    """The metrics observed during the write.

    Spark removes an empty input from the plan, and with it the observation; only
    then are the same aggregates computed by a query of their own.
    """
    from py4j.protocol import Py4JJavaError

    try:
        values = observation.get
    except Py4JJavaError:
        values = df.agg(*columns).first().asDict()
    return {name: _plain(value) for name, value in values.items()}


def _plain(value):
    return value if isinstance(value, (int, float, str, bool, type(None))) else str(value)


def read_published(spark, path: str) -> DataFrame:
    """The batch at ``path`` if its commit marker exists; otherwise an error."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        raise FileNotFoundError(f"{path} is not published")
    return spark.read.option("basePath", path).parquet(path)
