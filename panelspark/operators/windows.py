"""Lag, rolling, gap, z-score and regime operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.quantiles import exact_quantiles, global_quantiles, group_median
from panelspark.session import materialize


def price_dynamics(
    hourly: DataFrame,
    price: str = "price_day_ahead",
    zone: Sequence[str] = ("bzn",),
    time: str = "valid_time_utc",
    window: int = 24,
    minimum: int = 12,
) -> DataFrame:
    """Change to the previous row and rolling sample deviation per zone.

    Both are positional: gaps in time are not filled. The input has one row
    per zone and hour, so a zone is bounded by the calendar (8,784 rows a
    year), whatever the number of raw observations behind it.
    """
    if window < 2:
        raise ValueError("the volatility window must span at least 2 rows")
    ordered = W.partitionBy(*zone).orderBy(time)
    trailing = ordered.rowsBetween(-(window - 1), 0)
    return hourly.withColumns(
        {
            "price_change_eur_mwh": F.col(price) - F.lag(price).over(ordered),
            "price_volatility_24h": F.when(
                F.count(price).over(trailing) >= minimum, F.stddev_samp(price).over(trailing)
            ),
        }
    )


def time_steps(
    df: DataFrame, keys: Sequence[str], time: str, block: str = "hour"
) -> DataFrame:
    """(keys, time, previous): each distinct time with the one before it.

    A key may hold a third of all rows, so no window spans a whole key. The
    lag runs inside (key, block) groups; the first time of a block takes the
    last time of the nearest earlier block, read from one row per block.
    """
    distinct = (
        df.select(*keys, time)
        .where(F.col(time).isNotNull())
        .distinct()
        .withColumn("_block", F.date_trunc(block, time))
    )
    over_blocks = W.partitionBy(*keys).orderBy("_block")
    edges = (
        distinct.groupBy(*keys, "_block")
        .agg(F.max(time).alias("_last"))
        .withColumn("_previous_block", F.lag("_last").over(over_blocks))
        .drop("_last")
    )
    within = W.partitionBy(*keys, "_block").orderBy(time)
    joined = distinct.join(edges, [*keys, "_block"])
    previous = F.coalesce(F.lag(time).over(within), F.col("_previous_block"))
    return joined.select(*keys, time, previous.alias("previous"))


def missing_hour_intervals(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, missing_hour_intervals): steps longer than one hour."""
    steps = time_steps(df, keys, time)
    gap = F.timestamp_diff("MICROSECOND", F.col("previous"), F.col(time))
    return steps.groupBy(*keys).agg(
        F.count_if(gap > 3_600_000_000).alias("missing_hour_intervals")
    )


def resolution_minutes(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, resolution_minutes): median step; null for a single time."""
    steps = time_steps(df, keys, time).withColumn(
        "_step", F.timestamp_diff("MICROSECOND", F.col("previous"), F.col(time)) / F.lit(1e6)
    )
    steps = materialize(steps.select(*keys, "_step"), "time-steps")
    medians = group_median(steps, keys, "_step", "_median")
    present = steps.select(*keys).distinct()
    return present.join(medians, list(keys), "left").select(
        *keys, (F.col("_median") / 60).alias("resolution_minutes")
    )


def zscore_within_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``z_<column>`` per group; a zero deviation gives null.

    Statistics are aggregated with partial sums and joined back. They are
    written first, so Catalyst sees their size and only then may broadcast.
    """
    measures = []
    for c in columns:
        measures += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    stats = materialize(df.groupBy(*keys).agg(*measures), "group-moments")
    joined = df.join(stats, list(keys), "left")
    scores = {
        f"z_{c}": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
        for c in columns
    }
    return joined.withColumns(scores).drop(
        *[f"_{part}_{c}" for c in columns for part in ("m", "s")]
    )


def zscore_global(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``z_<column>`` over the whole frame; a zero deviation gives 0.0.

    Mean and deviation are one aggregated row, used as literals.
    """
    measures = []
    for c in columns:
        measures += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    stats = df.agg(*measures).first()
    scores = {}
    for c in columns:
        mean, deviation = stats[f"m_{c}"], stats[f"s_{c}"]
        usable = deviation is not None and deviation == deviation and deviation != 0
        scores[f"z_{c}"] = (
            (F.col(c) - F.lit(mean)) / F.lit(deviation) if usable else F.lit(0.0)
        )
    return df.withColumns(scores)


def regime_within_group(
    df: DataFrame, keys: Sequence[str], column: str, name: str = "high_renewable_regime"
) -> DataFrame:
    """1 where the value reaches the median of its group, 0 below or null."""
    medians = materialize(group_median(df, keys, column, "_median"), "group-medians")
    joined = df.join(medians, list(keys), "left")
    flag = F.coalesce(F.col(column) >= F.col("_median"), F.lit(False)).cast("int")
    return joined.withColumn(name, flag).drop("_median")


def regime_global(df: DataFrame, column: str, name: str = "high_renewable_regime") -> DataFrame:
    """1 where the value reaches the overall median, 0 below or null."""
    (median,) = global_quantiles(df, column, [0.5])
    flag = F.coalesce(F.col(column) >= F.lit(median).cast("double"), F.lit(False))
    return df.withColumn(name, flag.cast("int"))


__all__ = [
    "price_dynamics",
    "time_steps",
    "missing_hour_intervals",
    "resolution_minutes",
    "zscore_within_group",
    "zscore_global",
    "regime_within_group",
    "regime_global",
    "exact_quantiles",
]
