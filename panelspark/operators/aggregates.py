"""Grouped summaries: hourly means, error metrics, coverage, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelspark.constants import VARIABLE_LABELS, WEATHER_ERRORS, WEATHER_VARIABLES
from panelspark.operators.guards import duplicate_key_count
from panelspark.operators.quantiles import (
    average_ranks,
    bucketed,
    exact_quantiles,
    global_quantiles,
    group_median,
)
from panelspark.session import materialize


def weather_by_hour(weather: DataFrame, time: str = "event_time_utc") -> DataFrame:
    """Weather points of one hour: number of points, means and maxima."""
    return (
        weather.where(F.col(time).isNotNull())
        .groupBy(time)
        .agg(
            F.countDistinct("location").alias("weather_location_count"),
            F.avg("temperature_2m_c").alias("temperature_2m_c_mean"),
            F.avg("relative_humidity_2m_pct").alias("relative_humidity_2m_pct_mean"),
            F.avg("precipitation_mm").alias("precipitation_mm_mean"),
            F.max("precipitation_mm").alias("precipitation_mm_max"),
            F.avg("wind_speed_10m_kmh").alias("wind_speed_10m_kmh_mean"),
            F.max("wind_speed_10m_kmh").alias("wind_speed_10m_kmh_max"),
            F.avg("shortwave_radiation_w_m2").alias("shortwave_radiation_w_m2_mean"),
        )
    )


def errors_by_vintage_hour(
    errors: DataFrame, extra_keys: Sequence[str] = (), complete_from: int = 2
) -> DataFrame:
    """Mean error over the weather points of one (run, valid hour, horizon)."""
    keys = [*extra_keys, "forecast_run_utc", "valid_time_utc", "forecast_horizon_hours"]
    complete_rows = F.lit(True)
    for key in keys:
        complete_rows = complete_rows & F.col(key).isNotNull()
    # with the location among the keys a group has exactly one, and counting
    # distinct values would cost a second shuffle
    locations = F.max(F.lit(1)) if "location" in keys else F.countDistinct("location")
    return (
        errors.where(complete_rows)
        .groupBy(*keys)
        .agg(
            *[F.avg(c).alias(c) for c in WEATHER_ERRORS],
            locations.cast("bigint").alias("weather_location_count"),
        )
        .withColumn("weather_location_complete", F.col("weather_location_count") >= complete_from)
    )


def error_metrics(
    errors: DataFrame, keys: Sequence[str] = (), labelled: bool = False
) -> DataFrame:
    """n, bias, MAE, RMSE and largest absolute error per variable and group.

    All four variables are aggregated in one pass over the rows; the wide
    result (one row per group) is unpivoted afterwards, so no row is copied
    per variable before the shuffle.
    """
    measures: list[Column] = []
    for variable in WEATHER_VARIABLES:
        error = F.col(f"{variable}_error")
        measures.append(
            F.struct(
                F.lit(variable).alias("variable"),
                F.count(error).alias("n"),
                F.avg(error).alias("bias_forecast_minus_actual"),
                F.avg(F.abs(error)).alias("mae"),
                F.sqrt(F.avg(error * error)).alias("rmse"),
                F.max(F.abs(error)).alias("max_absolute_error"),
            )
        )
    grouped = errors.groupBy(*keys).agg(F.array(*measures).alias("_m"))
    flat = grouped.select(*keys, F.explode("_m").alias("_m")).select(*keys, "_m.*")
    return flat.withColumn("variable_label", variable_label("variable")) if labelled else flat


def variable_label(column: str) -> Column:
    pairs = [part for pair in VARIABLE_LABELS.items() for part in map(F.lit, pair)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.col(column))


def horizon_trend(metrics: DataFrame) -> DataFrame:
    """Least-squares trend of MAE on the horizon, for two bins or more."""
    usable = metrics.where(F.col("horizon_bin_start_hours").isNotNull() & F.col("mae").isNotNull())
    x = F.col("horizon_bin_start_hours").cast("double")
    return (
        usable.groupBy("variable")
        .agg(
            F.count(F.lit(1)).alias("horizon_bins"),
            F.regr_slope("mae", x).alias("mae_slope_per_hour"),
            F.corr(x, "mae").alias("horizon_mae_correlation"),
        )
        .where("horizon_bins >= 2")
        .select(
            "variable",
            variable_label("variable").alias("variable_label"),
            "horizon_bins",
            "mae_slope_per_hour",
            (F.col("mae_slope_per_hour") * 24).alias("mae_slope_per_24_hours"),
            F.when(~F.isnan("horizon_mae_correlation"), F.col("horizon_mae_correlation")).alias(
                "horizon_mae_correlation"
            ),
            F.when(F.col("mae_slope_per_hour") > 0, "descriptive upward MAE trend")
            .otherwise("no descriptive upward MAE trend")
            .alias("interpretation"),
        )
    )


# Output name -> (aggregate, input column) of the outcome tables.
OUTCOME_MEASURES = {
    "mean_price": ("avg", "price_day_ahead"),
    "price_std": ("stddev_samp", "price_day_ahead"),
    "price_volatility": ("avg", "price_volatility_24h"),
    "negative_price_rate": ("avg", "negative_price_flag"),
    "mean_temperature_error": ("avg", "temperature_absolute_error"),
    "mean_wind_error": ("avg", "wind_speed_absolute_error"),
    "mean_radiation_error": ("avg", "shortwave_radiation_absolute_error"),
    "mean_load_forecast_error": ("avg", "load_forecast_error_mw"),
    "valid_start_utc": ("min", "valid_time_utc"),
    "valid_end_utc": ("max", "valid_time_utc"),
}


def outcome_table(
    panel: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """rows plus the named outcome measures per group; null keys are left out."""
    for key in keys:
        panel = panel.where(F.col(key).isNotNull())
    columns = [F.count(F.lit(1)).alias("rows")]
    for name in measures:
        function, column = OUTCOME_MEASURES[name]
        columns.append(getattr(F, function)(column).alias(name))
    for name, column in (distinct or {}).items():
        columns.append(F.countDistinct(column).alias(name))
    return panel.groupBy(*keys).agg(*columns)


def price_coverage(panel: DataFrame, zone: str = "region") -> DataFrame:
    return panel.groupBy(zone).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_time_utc").alias("start_time_utc"),
        F.max("event_time_utc").alias("end_time_utc"),
        F.count_if(F.col("price_day_ahead_eur_mwh").isNull()).alias("price_missing"),
        F.count("price_day_ahead_eur_mwh").alias("model_rows"),
    )


# The seven conditions, in report order.
CONDITIONS = ["all", "rain", "no_rain", "high_wind", "not_high_wind", "cold", "not_cold"]


def condition_summary(panel: DataFrame) -> DataFrame:
    """Price outcomes under seven overlapping weather conditions, in one pass.

    A condition that never holds keeps its row, with 0 rows.
    """
    names = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("rain_flag"), "rain").otherwise("no_rain"),
            F.when(F.col("high_wind_flag"), "high_wind").otherwise("not_high_wind"),
            F.when(F.col("cold_weather_flag"), "cold").otherwise("not_cold"),
        )
    )
    tagged = panel.select(
        F.explode(names).alias("condition"),
        "price_day_ahead_eur_mwh",
        F.col("negative_price_flag").cast("int").alias("negative"),
        F.col("price_spike_flag").cast("int").alias("spike"),
        "renewable_share",
    )
    means = tagged.groupBy("condition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("price_day_ahead_eur_mwh").alias("mean_price_eur_mwh"),
        F.avg("negative").alias("negative_price_rate"),
        F.avg("spike").alias("price_spike_rate"),
        F.avg("renewable_share").alias("mean_renewable_share"),
    )
    medians = group_median(tagged, ["condition"], "price_day_ahead_eur_mwh", "median_price_eur_mwh")
    names_frame = panel.sparkSession.createDataFrame([(c,) for c in CONDITIONS], "condition string")
    joined = names_frame.join(means, "condition", "left").join(medians, "condition", "left")
    return joined.fillna(0, ["rows"])


def quantile_bin_curve(
    df: DataFrame, x: str, means: Mapping[str, str], bins: int = 20
) -> DataFrame:
    """Equal-frequency bins of ``x`` and the mean of other columns in each.

    Edges are interpolated quantiles; bins are open on the left and closed on
    the right, the lowest edge is closed and repeated edges are dropped.
    """
    edges = global_quantiles(df, x, [i / bins for i in range(bins + 1)])
    edges = sorted({e for e in edges if e is not None})
    if len(edges) < 2:
        raise ValueError(f"{x} has fewer than two distinct quantile edges")
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + F.when(F.col(x) > F.lit(edge), 1).otherwise(0)
    columns = [F.count(F.lit(1)).alias("rows"), F.avg(x).alias(x)]
    columns += [F.avg(source).alias(name) for name, source in means.items()]
    return df.where(F.col(x).isNotNull()).groupBy(number.alias("bin")).agg(*columns)


def error_distribution(errors: DataFrame, key: str = "horizon_bin_start_hours") -> DataFrame:
    """Box-plot figures of the absolute error per horizon bin and variable."""
    long = errors.select(
        key, *[F.col(f"{v}_absolute_error").alias(v) for v in WEATHER_VARIABLES]
    ).unpivot([key], list(WEATHER_VARIABLES), "variable", "absolute_error")
    long = long.where(F.col(key).isNotNull() & F.col("absolute_error").isNotNull())
    keys = [key, "variable"]
    quartiles = exact_quantiles(long, keys, "absolute_error", [0.25, 0.5, 0.75])

    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)

    boxes = materialize(
        quartiles.groupBy(*keys).agg(
            F.max("n").alias("n"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3")
        ),
        "boxes",
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("absolute_error")
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    return (
        long.join(boxes, keys)
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
        )
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing) for every column, from one aggregation."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "missing")


def match_summary(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(flag)).alias("matched_rows"),
        F.count_if(~F.col(flag)).alias("unmatched_rows"),
        F.avg(F.col(flag).cast("int")).alias("match_rate"),
    )


def _silver_counters() -> list[Column]:
    valid = F.col("event_time_utc").isNotNull()
    value = F.col("value")
    outside = ~value.between(0.0, 1.0)
    return [
        F.count(F.lit(1)).alias("non_null_values"),
        F.count_if(valid).alias("rows_written"),
        F.count_if(~valid).alias("invalid_timestamp_count"),
        F.count_if(valid & (F.col("unit") == "MW") & (value < 0)).alias(
            "negative_physical_value_count"
        ),
        F.count_if(valid & (F.col("unit") == "fraction") & outside).alias(
            "profile_out_of_range_count"
        ),
    ]


def silver_counters(long: DataFrame) -> DataFrame:
    """Quality counters of the long Silver table before bad times are dropped."""
    return long.agg(*_silver_counters())


def observe_silver(long: DataFrame, name: str = "silver_counters") -> tuple[DataFrame, Observation]:
    """The same rows, and the counters gathered while they are written.

    ``observation.get`` holds the counters after the write, so the delivery is
    not read a second time for its report.
    """
    observation = Observation(name)
    return long.observe(observation, *_silver_counters()), observation


def silver_report(long: DataFrame) -> dict:
    """Counters, duplicate keys and unmapped columns of a Silver batch.

    Unmapped columns are names of a file header, so their list is short.
    """
    valid = long.where(F.col("event_time_utc").isNotNull())
    duplicates = duplicate_key_count(valid, ["region", "metric", "event_time_utc"]).first()
    unmapped = valid.where(F.col("region") == "UNKNOWN").select("source_column").distinct()
    names = sorted(row[0] for row in unmapped.collect())
    return {
        **silver_counters(long).first().asDict(),
        "duplicate_key_count": duplicates["duplicate_key_count"],
        # the name that the contract of this dataset reads; here the whole batch counts
        "duplicate_key_count_within_chunks": duplicates["duplicate_key_count"],
        "unknown_column_count": len(names),
        "unknown_columns": names,
    }


def source_report(
    df: DataFrame, keys: Sequence[str], time: str, unique: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Rows, time range, invalid and duplicate counts and nulls per source.

    Rows are first counted per unique key, which both finds the duplicates
    and lets a hot source spread over the cluster.
    """
    names = [*keys, *[u for u in unique if u not in keys]]
    if time not in names:
        names.append(time)
    per_key = df.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(v).isNull()).alias(f"missing_{v}") for v in values],
    )
    return per_key.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.min(time).alias("start_time_utc"),
        F.max(time).alias("end_time_utc"),
        F.coalesce(F.sum(F.when(F.col(time).isNull(), F.col("_n"))), F.lit(0)).alias(
            "invalid_timestamp_count"
        ),
        F.sum(F.col("_n") - 1).alias("duplicate_key_count"),
        *[F.sum(f"missing_{v}").alias(f"missing_{v}") for v in values],
    )


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_x, column_y, n, spearman) over pairwise complete rows.

    Rows are exploded to column pairs and collapsed to distinct (x, y) value
    pairs before ranking. Ranks come from bucketed running counts, so neither
    a column nor a pair is ever ordered in one task.
    """
    pairs = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col(columns[i]).cast("double").alias("x"),
            F.col(columns[j]).cast("double").alias("y"),
        )
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    joint = materialize(
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("i", "j", "x", "y")
        .agg(F.count(F.lit(1)).alias("c")),
        "value-pairs",
    )
    ranked = joint
    for axis in ("x", "y"):
        hist = bucketed(joint.groupBy("i", "j", F.col(axis).alias("_v")).agg(F.sum("c").alias("_c")), ["i", "j"])
        ranks = average_ranks(hist, ["i", "j"]).select(
            "i", "j", F.col("_v").alias(axis), F.col("rank").alias(f"r{axis}")
        )
        ranked = ranked.join(ranks, ["i", "j", axis])
    n = F.sum("c")
    mean = (n + 1) / F.lit(2.0)
    sums = ranked.groupBy("i", "j").agg(
        n.alias("n"),
        (F.sum(F.col("c") * F.col("rx") * F.col("ry")) - n * mean * mean).alias("xy"),
        (F.sum(F.col("c") * F.col("rx") * F.col("rx")) - n * mean * mean).alias("xx"),
        (F.sum(F.col("c") * F.col("ry") * F.col("ry")) - n * mean * mean).alias("yy"),
    )
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    upper = sums.select("i", "j", "n", rho.alias("spearman"))
    lower = upper.where("i < j").select(
        F.col("j").alias("i"), F.col("i").alias("j"), "n", "spearman"
    )
    # pairs without a complete row still have their cell, with n = 0
    size = range(len(columns))
    grid = df.sparkSession.createDataFrame(
        [(i, j, columns[i], columns[j]) for i in size for j in size],
        "i int, j int, column_x string, column_y string",
    )
    cells = grid.join(upper.unionByName(lower), ["i", "j"], "left")
    return cells.select("column_x", "column_y", F.coalesce("n", F.lit(0)).alias("n"), "spearman")
