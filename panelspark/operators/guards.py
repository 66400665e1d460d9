"""Checks that refuse ambiguous or incomplete inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    """An input breaks a rule that would make the result ambiguous."""


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataQualityError(f"{name} lacks required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key, over the whole input."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        )
    )


def refuse_duplicates(df: DataFrame, keys: Sequence[str], name: str = "input") -> DataFrame:
    """Raise when a key repeats; returns the input unchanged otherwise."""
    offenders = duplicate_keys(df, keys).limit(5).collect()
    if offenders:
        shown = [tuple(row[k] for k in keys) for row in offenders]
        raise DataQualityError(f"{name} has duplicate keys on {list(keys)}, such as {shown}")
    return df


def check_cardinality(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str
) -> None:
    """Validate ``one_to_one`` or ``many_to_one`` before a join."""
    if rule not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality rule: {rule}")
    refuse_duplicates(right, keys, "right side")
    if rule == "one_to_one":
        refuse_duplicates(left, keys, "left side")


def equal_length(first: Column, second: Column, label: Column) -> Column:
    """``first`` when both arrays have one length, else a runtime error.

    Needed because zipping arrays of different length pads with nulls.
    """
    message = F.concat(
        F.coalesce(label, F.lit("series")),
        F.lit(": timestamp/value length mismatch ("),
        F.size(first).cast("string"),
        F.lit(" vs "),
        F.size(second).cast("string"),
        F.lit(")"),
    )
    return F.when(F.size(first) == F.size(second), first).otherwise(F.raise_error(message))


def missing_required(
    df: DataFrame, group: str, member: str, required: Sequence[str]
) -> DataFrame:
    """(group, missing member): required members a group never shows."""
    present = df.select(group, member).distinct()
    groups = df.select(group).distinct()
    expected = groups.select(
        group, F.explode(F.array(*[F.lit(r) for r in required])).alias(member)
    )
    return expected.join(present, [group, member], "left_anti")
