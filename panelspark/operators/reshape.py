"""Melt, pivot, union and rename."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import to_double, unit_of_metric
from panelspark.operators.guards import DataQualityError


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    variable: str = "source_column",
    value: str = "value",
    drop_null: bool = True,
) -> DataFrame:
    """Wide to long; values are coerced to double and nulls dropped."""
    typed = df.select(*ids, *[to_double(F.col(f"`{v}`")).alias(v) for v in values])
    long = typed.unpivot(list(ids), list(values), variable, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def map_dimensions(long: DataFrame, mapping: DataFrame, column: str = "source_column") -> DataFrame:
    """Attach region and metric by column name; unmapped columns stay visible.

    ``mapping`` holds one row per source column (a file header), so it is
    broadcast. Its size is unknown to Catalyst when it comes from a list or a
    grouping, and a shuffle would bring all rows of a source column together.
    """
    known = mapping.select(
        F.col("column").alias(column),
        F.col("region").alias("_r"),
        F.col("metric").alias("_m"),
        unit_of_metric("metric").alias("_u"),
    )
    joined = long.join(F.broadcast(known), column, "left")
    # the unit of a mapped column is worked out once, on the mapping row
    return joined.withColumns(
        {
            "region": F.coalesce("_r", F.lit("UNKNOWN")),
            "metric": F.coalesce("_m", column),
            "unit": F.coalesce("_u", unit_of_metric(column)),
        }
    ).drop("_r", "_m", "_u")


def pivot_metrics(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    metric: str = "metric",
    value: str = "value",
    how: str = "mean",
    every_key: bool = False,
) -> DataFrame:
    """Long to wide over a fixed metric list, so every column always exists.

    ``mean`` averages repeated observations. ``strict`` refuses them: a
    repeated (key, metric) is a data error there and raises while running. Keys
    without any metric of the list have no row, unless ``every_key`` asks for
    them, with nulls (then unlisted metrics must not repeat either).
    """
    keep = df.where(F.col(metric).isin(*metrics))
    if how == "strict":
        counted = (df if every_key else keep).groupBy(*keys, metric).agg(
            F.count(F.lit(1)).alias("_n"), F.max(value).alias("_value")
        )
        checked = F.when(
            F.col("_n") > 1,
            F.raise_error(
                F.concat(F.lit("duplicate key in pivot for metric "), F.col(metric))
            ).cast("double"),
        ).otherwise(F.col("_value"))
        keep = counted.withColumn("_value", checked)
        return keep.groupBy(*keys).pivot(metric, list(metrics)).agg(F.max("_value"))
    if how == "mean":
        # One conditional mean per metric: a single partial and final
        # aggregation, where a pivot would first group by metric as well.
        # The metric filter stays outside so that hours without any metric
        # of the list produce no row.
        means = [
            F.avg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics
        ]
        return keep.groupBy(*keys).agg(*means)
    raise DataQualityError(f"unknown pivot rule: {how}")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a source lacks become null."""
    if not frames:
        raise DataQualityError("no source frames to union")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
