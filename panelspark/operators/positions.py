"""Exact row positions in a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import materialize


ROWS_PER_RANGE = 2_000_000


def with_positions(
    df: DataFrame, order: Sequence[str], name: str = "_pos", rows: int = 0
) -> DataFrame:
    """Adds the 0-based position of each row in ``order``.

    Rows are range-partitioned and sorted inside each range, so a repeated
    leading key is split by the later ones. The row number inside a range is
    the low part of ``monotonically_increasing_id``. The ranges depend on a
    sample, so the numbered rows are written once before the range sizes are
    counted; both reads then see the same ranges. ``rows``, when known, sets how
    many ranges there are. ``order`` must identify a
    row; ties would make the positions arbitrary.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(ranges, -(-rows // ROWS_PER_RANGE))
    sequence = F.monotonically_increasing_id()
    numbered = materialize(
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", sequence),
        "positions",
    )
    bits = 33
    split = numbered.withColumn("_range", F.shiftright("_seq", bits)).withColumn(
        "_row", F.col("_seq") - F.shiftleft(F.col("_range"), bits)
    )
    sizes = split.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range, so the running sum is over as few rows as there are tasks
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    offsets = materialize(offsets, "range-offsets")
    return (
        split.join(offsets, "_range")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_seq", "_range", "_row", "_before")
    )
