"""Properties of the physical plans."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from panelspark.operators import aggregates as A
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.regression import Model, cell_moments, usable_rows
from panelspark.operators.reshape import map_dimensions
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.session import materialize, scratch_path

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_region_filter_and_columns_reach_the_scan(spark):
    long = materialize(X.research_long(spark, SF), "silver")
    text = plan(marts.energy_research(long, "DE_LU", "b", "now", check=False))
    assert re.search(r"PushedFilters: \[.*EqualTo\(region,DE_LU\)", text)
    text = plan(long.where(long.region.isin("FR", "AT")).select("value"))
    assert "In(region, [" in text and "ReadSchema: struct<region:string,value:double>" in text


def test_market_scan_reads_three_columns(spark):
    text = plan(X.market_hourly(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas and all({c.split(":")[0] for c in s.split(",")} <= {"ts", "user_id", "event_type", "value"} for s in schemas)


def test_hourly_mean_has_one_partial_aggregation(spark):
    text = plan(X.market_hourly(spark, SF))
    # two exchanges: by (zone, hour) for the means, by zone for the hourly window
    assert text.count("Exchange\n") <= 4 and "partial_avg" in text


def test_no_window_without_partition_over_rows(spark):
    frame = materialize(X.market_observations(spark, SF), "market")
    text = plan(exact_quantiles(frame, ["bzn"], "value", [0.5]))
    for line in re.findall(r"Arguments: .*windowspecdefinition\((.*)\)", text):
        assert line.startswith("bzn")


def test_flagship_has_no_cross_join(spark):
    text = plan(X.impact_panel(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cells_are_partially_aggregated_before_the_shuffle(spark):
    model = Model("l_extendedprice", ("l_quantity",), ("ship_month",))
    rows = usable_rows(X.regression_sample(spark, SF), model)
    text = plan(cell_moments(rows, model))
    assert "partial_sum" in text and "Python" not in text


def test_partition_filter_prunes_files(spark, folder):
    X.market_observations(spark, SF).write.partitionBy("bzn").parquet(f"{folder}/m")
    text = plan(spark.read.parquet(f"{folder}/m").where("bzn = 'FR'"))
    assert re.search(r"PartitionFilters: \[.*bzn.*FR", text)


def test_scratch_follows_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = scratch_path(spark, "x")
    assert root.startswith((configured or spark.sparkContext.getCheckpointDir()).rstrip("/") + "/")


def deliveries(spark, folder):
    """A wide delivery of 4,000 rows in 8 files, and a mapping of one of its two columns."""
    rows = spark.range(0, 4000, 1, 8).select(
        F.lit("2024-06-01 00:00:00").alias("utc"), F.col("id").cast("string").alias("cet"),
        F.col("id").cast("double").alias("a"), F.lit(-1.0).alias("b"),
    )
    rows.write.parquet(f"{folder}/wide")
    mapping = spark.createDataFrame([("a", "AT", "load")], "column string, region string, metric string")
    return spark.read.parquet(f"{folder}/wide"), mapping


def test_silver_rows_are_not_shuffled_by_source_column(spark, folder):
    wide, mapping = deliveries(spark, folder)
    long = marts.with_valid_time(marts.silver_long(wide, mapping, "utc", "cet", ["a", "b"], "b1", "now"))
    text = plan(long)
    assert "BroadcastHashJoin LeftOuter BuildRight" in text and "hashpartitioning" not in text
    got = long.groupBy("source_column", "region", "metric", "unit").agg(F.count("*"), F.sum("value"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", "AT", "load", "MW", 4000, 7998000.0), ("b", "UNKNOWN", "b", "MW", 4000, -4000.0)
    }


def test_quality_counters_move_only_partial_counts(spark, folder):
    wide, mapping = deliveries(spark, folder)
    late = wide.withColumn("utc", F.when(F.col("a") >= 1000, F.col("utc")).otherwise("soon"))
    long = marts.silver_long(late, mapping, "utc", "cet", ["a", "b"], "b1", "now")
    counters = A.silver_counters(long)
    text = plan(counters)
    assert "hashpartitioning" not in text and "partial_count" in text
    row = counters.first()
    assert (row.non_null_values, row.rows_written, row.invalid_timestamp_count) == (8000, 6000, 2000)
    assert row.negative_physical_value_count == 3000


def test_mapped_rows_stay_in_their_task(spark):
    """Unmapped columns stay visible; a mapping from a grouping is broadcast too."""
    long = spark.range(1000).select(
        F.col("id"), F.concat(F.lit("c"), F.col("id") % 3).alias("source_column"), F.lit(1.0).alias("value")
    )
    rows = [("c0", "AT", "solar_profile"), ("c1", "FR", "price_day_ahead")]
    listed = spark.createDataFrame(rows, "column string, region string, metric string")
    grouped = listed.groupBy("column").agg(F.max("region").alias("region"), F.max("metric").alias("metric"))
    for mapping in (listed, grouped):
        mapped = map_dimensions(long, mapping)
        text = plan(mapped)
        assert "BroadcastHashJoin LeftOuter BuildRight" in text and "SortMergeJoin" not in text
        got = mapped.groupBy("source_column", "region", "metric", "unit").count()
        assert {tuple(r) for r in got.collect()} == {
            ("c0", "AT", "solar_profile", "fraction", 334), ("c1", "FR", "price_day_ahead", "EUR/MWh", 333),
            ("c2", "UNKNOWN", "c2", "MW", 333),
        }
