"""Exact order statistics without pulling a group into one task.

Two levels: values are first collapsed to a histogram (value, count), which is
range-partitioned by group and value and written. The partitions are the buckets, so
their limits follow the data, however narrow, tiny or heavy-tailed the values are,
and a hot group spans many of them. A running sum over the bucket totals of a
group tells which bucket holds each wanted rank; only those buckets are
then ordered, each in its own task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import materialize


def bucketed(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_b``: a bucket number that never decreases with the value in a group.

    The histogram is written, so what it was made from is evaluated once.
    """
    ranged = hist.repartitionByRange(*keys, "_v").withColumn("_b", F.spark_partition_id())
    return materialize(ranged, "histogram")


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _c): distinct non-null values and how often they occur."""
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return bucketed(counted, keys)


def _bucket_offsets(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _b, _n, _before, _total): rows in and before each bucket."""
    totals = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    running = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """(keys, probability, quantile, n) with linear interpolation.

    Groups without a non-null value are absent. Null keys form a group.
    """
    hist = histogram(df, keys, value)
    offsets = _bucket_offsets(hist, keys)
    wanted = []
    for index, probability in enumerate(probabilities):
        place = F.lit(float(probability)) * (F.col("_total") - 1).cast("double")
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            wanted.append(
                F.struct(
                    F.lit(index).alias("index"),
                    F.lit(end).alias("end"),
                    rank.cast("bigint").alias("rank"),
                    (place - F.floor(place)).alias("share"),
                )
            )
    targets = (
        offsets.withColumn("_wanted", F.array(*wanted))
        .withColumn(
            "_wanted",
            F.filter(
                "_wanted",
                lambda w: (w["rank"] >= F.col("_before"))
                & (w["rank"] < F.col("_before") + F.col("_n")),
            ),
        )
        .where(F.size("_wanted") > 0)
        .select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_b").alias("_t_b"),
                "_before", "_total", "_wanted")
    )
    on = F.col("_b") == F.col("_t_b")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_t_{key}"))
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = hist.join(targets, on).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )
    picked = (
        placed.select(*keys, "_v", "_c", "_start", "_total", F.explode("_wanted").alias("w"))
        .where((F.col("w.rank") >= F.col("_start")) & (F.col("w.rank") < F.col("_start") + F.col("_c")))
    )
    low = F.max(F.when(F.col("w.end") == "lo", F.col("_v")))
    high = F.max(F.when(F.col("w.end") == "hi", F.col("_v")))
    levels = F.array(*[F.lit(float(p)) for p in probabilities])
    return (
        picked.groupBy(*keys, F.col("w.index").alias("_i"))
        .agg(
            (low + (high - low) * F.max("w.share")).alias("quantile"),
            F.max("_total").alias("n"),
        )
        .select(*keys, F.element_at(levels, F.col("_i") + 1).alias("probability"), "quantile", "n")
    )


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): exact median per group."""
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias(name))


def global_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles of the whole frame as driver numbers (one per probability)."""
    rows = exact_quantiles(df, [], value, probabilities).collect()
    found = {row["probability"]: row["quantile"] for row in rows}
    return [found.get(float(p)) for p in probabilities]


def average_ranks(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _v, _c, rank): 1-based ranks, ties share their average."""
    offsets = _bucket_offsets(hist, keys).select(*keys, "_b", "_before")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    joined = hist.join(offsets, [*keys, "_b"])
    start = F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    return joined.select(
        *keys, "_v", "_c", (start + (F.col("_c") + 1) / F.lit(2.0)).alias("rank")
    )
