"""Left joins with checked cardinality and a match marker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.guards import DataQualityError, check_cardinality


def left_join_marked(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    marker: str = "match_flag",
    cardinality: str | None = "many_to_one",
) -> DataFrame:
    """``left`` kept whole, plus the right columns and a boolean marker.

    Null keys never match. Pass ``cardinality=None`` only when the right side
    is unique by construction (the result of a grouping on the same keys).
    """
    if cardinality:
        check_cardinality(left, right, keys, cardinality)
    tagged = right.withColumn(marker, F.lit(True))
    joined = left.join(tagged, list(keys), "left")
    return joined.withColumn(marker, F.coalesce(marker, F.lit(False)))


def left_join_indicator(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    indicator: str,
    cardinality: str | None = "one_to_one",
) -> DataFrame:
    """As above with the texts ``both`` and ``left_only`` in the indicator."""
    joined = left_join_marked(left, right, keys, indicator, cardinality)
    text = F.when(F.col(indicator), F.lit("both")).otherwise(F.lit("left_only"))
    return joined.withColumn(indicator, text)


def zone_location_map(
    spark: SparkSession, defaults: dict[str, str], overrides: Sequence[str] = ()
) -> DataFrame:
    """(bzn, location): the defaults with ``zone=location`` overrides on top."""
    rows = [(zone, location, 0) for zone, location in defaults.items()]
    for order, item in enumerate(overrides, start=1):
        zone, separator, location = item.partition("=")
        if not separator:
            raise DataQualityError(f"not a zone=location pair: {item}")
        rows.append((zone, location, order))
    schema = "bzn string, location string, priority int"
    return (
        spark.createDataFrame(rows, schema)
        .groupBy("bzn")
        .agg(F.max_by("location", "priority").alias("location"))
    )


def require_mapped(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Raise when a key of ``df`` has no row in ``mapping``."""
    unmapped = df.select(key).distinct().join(mapping, key, "left_anti").limit(5).collect()
    if unmapped:
        raise DataQualityError(f"no mapping for {key} in {[row[key] for row in unmapped]}")
    return df
