"""The model sets fitted on the marts, with their gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import IMPACT_PREDICTORS
from panelspark.functions.columns import calendar_fields
from panelspark.operators.regression import (
    Fit,
    Model,
    fit_cluster,
    fit_hac,
    fit_two_way_cluster,
)
from panelspark.operators.windows import (
    regime_global,
    regime_within_group,
    zscore_global,
    zscore_within_group,
)
from panelspark.session import materialize

REGIME = "high_renewable_regime"
SHARE = "actual_renewable_share_of_load"
Z_TERMS = tuple(f"z_{p}" for p in IMPACT_PREDICTORS)
INTERACTIONS = tuple(f"{z}:{REGIME}" for z in Z_TERMS[:4])

COEFFICIENT_SCHEMA = (
    "model string, outcome string, term string, coefficient double, std_error double, "
    "t_value double, p_value double, ci_low double, ci_high double, n long, r_squared double"
)
SUMMARY_SCHEMA = (
    "model string, outcome string, status string, n long, r_squared double, "
    "adjusted_r_squared double, inference_df int, reason string"
)


def run_suite(
    frame: DataFrame, models: Sequence[Model], fit: Callable[[DataFrame, Model], Fit], gate: int
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, summaries); a failed or skipped model never stops the rest.

    A model is skipped when fewer than ``gate`` rows have its outcome. The
    counts of all outcomes come from one aggregation.
    """
    spark = frame.sparkSession
    outcomes = list(dict.fromkeys(m.outcome for m in models))
    counts = frame.agg(*[F.count(o).alias(o) for o in outcomes]).first().asDict()

    def one(model: Model) -> tuple[list[tuple], tuple]:
        n = counts[model.outcome]
        if n < gate:
            reason = f"fewer than {gate} complete observations"
            return [], (model.name, model.outcome, "SKIPPED", n, None, None, None, reason)
        try:
            result = fit(frame, model)
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError) as problem:
            return [], (model.name, model.outcome, "FAILED", n, None, None, None, str(problem))
        rows = [
            (model.name, model.outcome, *row.values(), result.n, float(result.r_squared))
            for row in result.table()
        ]
        return rows, (
            model.name, model.outcome, "PASS", result.n, float(result.r_squared),
            float(result.adjusted_r_squared), result.df, None,
        )

    # the models are independent, so their jobs may share the cluster
    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(one), models))
    coefficients = [row for rows, _ in results for row in rows]
    summaries = [summary for _, summary in results]
    return (
        spark.createDataFrame(coefficients, COEFFICIENT_SCHEMA),
        spark.createDataFrame(summaries, SUMMARY_SCHEMA),
    )


def _impact_models(factors: tuple[str, ...], suffix: str, main_effect: bool) -> list[Model]:
    regime = (REGIME,) if main_effect else ()
    full = (*Z_TERMS, *regime, *INTERACTIONS)
    negative_terms = full if main_effect else Z_TERMS
    return [
        Model("price_day_ahead", Z_TERMS, factors, f"price_level{suffix}"),
        Model("price_day_ahead", full, factors, f"price_level_regime_interactions{suffix}"),
        Model("price_volatility_24h", Z_TERMS, factors, f"price_volatility{suffix}"),
        Model("negative_price_flag", negative_terms, factors, f"negative_price{suffix}"),
    ]


def _with_calendar(panel: DataFrame) -> DataFrame:
    """Matched rows and the columns a suite reads, written once.

    Medians, deviations and the design all read this table; without it the
    mart would be computed for each of them.
    """
    fields = calendar_fields("valid_time_utc")
    outcomes = ["price_day_ahead", "price_volatility_24h", "negative_price_flag"]
    return materialize(
        panel.where("market_match_flag").select(
            "bzn", "valid_time_utc", "forecast_run_utc", SHARE, *outcomes, *IMPACT_PREDICTORS,
            *[fields[name].alias(name) for name in ("hour_utc", "day_of_week", "valid_date")],
        ),
        "matched",
    )


def _needed(frame: DataFrame, extra: Sequence[str]) -> DataFrame:
    """The columns a suite reads, written once for all of its models."""
    names = [*extra, "price_day_ahead", "price_volatility_24h", "negative_price_flag",
             REGIME, *Z_TERMS]
    return materialize(frame.select(*names), "design")


def single_zone_suite(panel: DataFrame, lags: int = 24) -> tuple[DataFrame, DataFrame]:
    """Four HAC models over one zone and run, hour and weekday effects."""
    frame = zscore_global(regime_global(_with_calendar(panel), SHARE), IMPACT_PREDICTORS)
    order = ["valid_time_utc", "forecast_run_utc"]
    design = _needed(frame, [*order, "hour_utc", "day_of_week"])
    models = _impact_models(("hour_utc", "day_of_week"), "_single_zone", main_effect=False)
    return run_suite(design, models, lambda d, m: fit_hac(d, m, order, lags), gate=60)


def _two_way(frame: DataFrame, model: Model) -> Fit:
    return fit_two_way_cluster(frame, model, "valid_time_utc", "forecast_run_utc")


def multi_vintage_suite(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four two-way clustered models over the vintages of one zone."""
    frame = zscore_global(regime_global(_with_calendar(panel), SHARE), IMPACT_PREDICTORS)
    design = _needed(frame, ["valid_time_utc", "forecast_run_utc", "hour_utc", "valid_date"])
    models = _impact_models(("hour_utc", "valid_date"), "_multi_vintage", main_effect=True)
    return run_suite(design, models, _two_way, gate=100)


def multi_zone_suite(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four two-way clustered models over zones and vintages."""
    matched = regime_within_group(_with_calendar(panel), ["bzn"], SHARE)
    frame = zscore_within_group(matched, ["bzn"], IMPACT_PREDICTORS)
    keys = ["valid_time_utc", "forecast_run_utc", "bzn", "hour_utc", "valid_date"]
    design = _needed(frame, keys)
    models = _impact_models(("bzn", "hour_utc", "valid_date"), "_multi_zone", main_effect=True)
    return run_suite(design, models, _two_way, gate=100)


ENERGY_TERMS = ("renewable_share_pct", "load_forecast_error_gw")


def energy_design(panel: DataFrame) -> DataFrame:
    """Percent and gigawatt units, and the flag as a number."""
    return panel.withColumns(
        {
            "renewable_share_pct": F.col("renewable_share") * 100,
            "load_forecast_error_gw": F.col("load_forecast_error_mw") / 1000,
            "negative_price_flag": F.col("negative_price_flag").cast("int"),
        }
    )


def energy_weather_suite(panel: DataFrame, lags: int = 24) -> tuple[DataFrame, DataFrame]:
    """Two HAC models of price and negative price on share and weather."""
    numeric = (
        "renewable_share_pct",
        "temperature_2m_c_mean",
        "wind_speed_10m_kmh_mean",
        "load_forecast_error_gw",
    )
    factors = ("hour_utc", "day_of_week", "year")
    outcomes = ["price_day_ahead_eur_mwh", "negative_price_flag"]
    # both models use the rows complete in every model column
    design = energy_design(panel).dropna(subset=[*outcomes, *numeric, *factors])
    design = materialize(design.select("event_time_utc", *outcomes, *numeric, *factors), "design")
    models = [Model(o, numeric, factors, f"{o}_hac") for o in outcomes]
    return run_suite(design, models, lambda d, m: fit_hac(d, m, ["event_time_utc"], lags), 1)


def zone_panel_suite(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two models clustered by region with region and calendar effects."""
    factors = ("region", "hour_utc", "day_of_week", "year")
    outcomes = ["price_day_ahead_eur_mwh", "negative_price_flag"]
    design = energy_design(panel).dropna(subset=[*outcomes, *ENERGY_TERMS, *factors])
    design = materialize(design.select(*outcomes, *ENERGY_TERMS, *factors), "design")
    models = [Model(o, ENERGY_TERMS, factors, f"{o}_by_region") for o in outcomes]
    return run_suite(design, models, lambda d, m: fit_cluster(d, m, "region"), 1)
