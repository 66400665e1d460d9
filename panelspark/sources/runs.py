"""Catalog of forecast runs and weather points."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import (
    FIRST_RUN_YEAR,
    LOCATION_COORDINATES,
    RUN_HOURS,
    RUN_INTERVALS,
)


def location_array(names: Sequence[str]) -> Column:
    """Weather points as an array of (location, latitude, longitude)."""
    unknown = sorted(set(names) - set(LOCATION_COORDINATES))
    if unknown:
        raise ValueError(f"unknown locations: {unknown}")
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("location"),
                F.lit(LOCATION_COORDINATES[n][0]).alias("latitude"),
                F.lit(LOCATION_COORDINATES[n][1]).alias("longitude"),
            )
            for n in names
        ]
    )


def runs_between(bounds: DataFrame, interval_hours: int, locations: Sequence[str]) -> DataFrame:
    """(forecast_run_utc, location, ...) for each (start_run, end_run) row."""
    if interval_hours not in RUN_INTERVALS:
        raise ValueError(f"runs are {RUN_INTERVALS} hours apart")
    step = F.expr(f"interval {interval_hours} hours")
    runs = bounds.select(
        F.explode(F.sequence("start_run", "end_run", step)).alias("forecast_run_utc")
    )
    valid = F.hour("forecast_run_utc").isin(*RUN_HOURS) & (
        F.year("forecast_run_utc") >= FIRST_RUN_YEAR
    )
    return (
        runs.where(valid)
        .select("forecast_run_utc", F.explode(location_array(locations)).alias("l"))
        .select("forecast_run_utc", "l.*")
    )


def run_catalog(
    spark: SparkSession, start: str, count: int, interval_hours: int, locations: Sequence[str]
) -> DataFrame:
    """``count`` runs from ``start`` (``yyyy-MM-ddTHH:mm``) for each location."""
    first = datetime.strptime(start, "%Y-%m-%dT%H:%M")
    if count <= 0:
        raise ValueError("the run count must be positive")
    if first.hour not in RUN_HOURS or first.year < FIRST_RUN_YEAR:
        raise ValueError(f"runs start at {RUN_HOURS} UTC from {FIRST_RUN_YEAR} on")
    begin = F.to_timestamp(F.lit(start), "yyyy-MM-dd'T'HH:mm")
    bounds = spark.range(1).select(
        begin.alias("start_run"),
        F.timestamp_add("HOUR", F.lit(interval_hours * (count - 1)), begin).alias("end_run"),
    )
    return runs_between(bounds, interval_hours, locations)
