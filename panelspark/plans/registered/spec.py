"""How a query is registered together with its oracle.

A query states its result columns once, as ``name kind`` pairs. The same
statement shapes the Spark result and the SQL text: integers become bigint,
doubles are rounded, times lose their zone, lists become text. A tiny offset
before rounding keeps short decimals away from rounding ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans.fixtures import with_ctes
from panelspark.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

_SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}
_SPARK_TYPES = {"i": "bigint", "s": "string", "b": "boolean", "t": "timestamp_ntz"}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in columns.split(",")]


def _offset(digits: int) -> float:
    return 0.031 * 10.0**-digits


def _spark_column(name: str, kind: str) -> Column:
    if kind[0] == "d":
        digits = int(kind[1:] or 6)
        value = F.round(F.col(name).cast("double") + F.lit(_offset(digits)), digits)
    elif kind == "l":
        value = F.array_join(name, "|")
    else:
        value = F.col(name).cast(_SPARK_TYPES[kind])
    return value.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind[0] == "d":
        digits = int(kind[1:] or 6)
        return f'round(CAST("{name}" AS DOUBLE) + {_offset(digits):.12e}, {digits}) AS "{name}"'
    if kind == "l":
        return f"array_to_string(\"{name}\", '|') AS \"{name}\""
    return f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"'


def query(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Register a builder; ``ctes`` names the definitions the SQL builds on."""
    parsed = _parse(columns)

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(prepare(spark), sf_dir)
            return result.select(*[_spark_column(n, k) for n, k in parsed])

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            shaped = ", ".join(_sql_column(n, k) for n, k in parsed)
            body = f"SELECT {shaped} FROM ({sql.strip()}) AS result_rows"
            ORACLES[name] = with_ctes(body, *ctes.split())
        return build

    return register


