"""Column expressions of the Silver and Gold layers (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(value: Column | str) -> Column:
    """Cast to double; text that is not a number and NaN both become null."""
    number = _c(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_timestamp(value: Column | str, fmt: str | None = None) -> Column:
    """Parse a UTC timestamp; text that is not a time becomes null.

    ``2024-06-01T00:00Z`` lacks the seconds that a zone suffix requires, so
    they are filled in first.
    """
    if fmt:
        return F.try_to_timestamp(_c(value), F.lit(fmt))
    zoned = r"^(.*[T ][0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:?[0-9]{2})$"
    return F.try_to_timestamp(F.regexp_replace(_c(value), zoned, "$1:00$2"))


def epoch_to_timestamp(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_c(seconds))


def hour_floor(time: Column | str) -> Column:
    return F.date_trunc("hour", _c(time))


def calendar_fields(time: Column | str) -> dict[str, Column]:
    """hour, weekday (Monday is 0), weekend flag, year, month and date text."""
    time = _c(time)
    weekday = F.weekday(time)
    return {
        "hour_utc": F.hour(time).cast("tinyint"),
        "day_of_week": weekday.cast("tinyint"),
        "is_weekend": weekday >= 5,
        "year": F.year(time).cast("smallint"),
        "month": F.month(time).cast("tinyint"),
        "valid_date": F.date_format(time, "yyyy-MM-dd"),
    }


def unit_of_metric(metric: Column | str) -> Column:
    """Unit by metric name: profiles are fractions, prices EUR/MWh, else MW."""
    name = F.lower(_c(metric))
    return (
        F.when(name.contains("profile"), F.lit("fraction"))
        .when(name.contains("price"), F.lit("EUR/MWh"))
        .otherwise(F.lit("MW"))
    )


def unit_of_power_series(name: Column | str) -> Column:
    return F.when(F.lower(_c(name)).contains("share"), F.lit("pct")).otherwise(F.lit("MW"))


def normalized_name(name: Column | str, prefix: str = "") -> Column:
    """Lower-case identifier: '&' is spelled out, other symbols become '_'."""
    spelled = F.replace(F.lower(_c(name)), F.lit("&"), F.lit("and"))
    snake = F.btrim(F.regexp_replace(spelled, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit(prefix), snake) if prefix else snake


def horizon_hours(run: Column | str, valid: Column | str) -> Column:
    """Fractional hours from the model run to the hour it predicts."""
    seconds = F.timestamp_diff("MICROSECOND", _c(run), _c(valid)) / F.lit(1e6)
    return seconds / F.lit(3600.0)


def horizon_bin_start(hours: Column | str, width: int = 24) -> Column:
    if width <= 0:
        raise ValueError("the horizon bin width must be positive")
    return (F.floor(_c(hours) / F.lit(float(width))) * F.lit(width)).cast("bigint")


def horizon_bin_label(start: Column | str, width: int = 24) -> Column:
    """``'24-47h'``; a null start is labelled ``'unknown'``."""
    start = _c(start)
    text = F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string"), F.lit("h"))
    return F.coalesce(text, F.lit("unknown"))


def error_pair(forecast: Column | str, actual: Column | str) -> tuple[Column, Column]:
    """Signed error (forecast minus actual) and its absolute value."""
    signed = _c(forecast) - _c(actual)
    return signed, F.abs(signed)


def load_error(actual: Column | str, forecast: Column | str, convention: str) -> Column:
    """Load error under the sign convention of the source.

    ``actual_minus_forecast`` for the wide time-series marts,
    ``forecast_minus_actual`` for the market marts.
    """
    if convention == "actual_minus_forecast":
        return _c(actual) - _c(forecast)
    if convention == "forecast_minus_actual":
        return _c(forecast) - _c(actual)
    raise ValueError(f"unknown error convention: {convention}")


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator where the denominator is positive, else null."""
    below = _c(denominator)
    return F.when(below > 0, _c(numerator) / below)


def flag_below(value: Column | str, limit: float, fill: float | None = None) -> Column:
    """value < limit; a null counts as ``fill`` when given, else as false."""
    value = _c(value) if fill is None else F.coalesce(_c(value), F.lit(fill))
    return F.coalesce(value < F.lit(limit), F.lit(False))


def flag_at_least(value: Column | str, limit: float, fill: float | None = None) -> Column:
    value = _c(value) if fill is None else F.coalesce(_c(value), F.lit(fill))
    return F.coalesce(value >= F.lit(limit), F.lit(False))


def flag_above(value: Column | str, limit: float, fill: float | None = None) -> Column:
    value = _c(value) if fill is None else F.coalesce(_c(value), F.lit(fill))
    return F.coalesce(value > F.lit(limit), F.lit(False))


def known_at(run: Column | str, valid: Column | str) -> Column:
    """Availability proxy: the run started no later than the hour it predicts."""
    return _c(run) <= _c(valid)
