"""Least squares with fixed effects and robust covariances on Spark.

Row-scale work is aggregation. The cross products of the numeric columns are
summed per combination of fixed-effect levels in the JVM (a hot combination
collapses in the map-side partial sums), and those cells are folded into one
k x k matrix inside the tasks. The driver only sees k x k matrices; k, the
number of terms, is checked against ``max_terms``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.distributions import (
    normal_quantile,
    normal_two_sided,
    student_quantile,
    student_two_sided,
)
from panelspark.operators.positions import with_positions
from panelspark.session import materialize

MAX_TERMS = 1000


@dataclass(frozen=True)
class Model:
    """An outcome, numeric terms and categorical fixed effects.

    The first level of each factor (in sort order) is the reference level.
    A numeric term ``a:b`` is the product of the columns a and b.
    """

    outcome: str
    numeric: tuple[str, ...]
    factors: tuple[str, ...] = ()
    name: str = ""

    @property
    def source_columns(self) -> list[str]:
        parts = [p for term in self.numeric for p in term.split(":")]
        return list(dict.fromkeys([self.outcome, *parts, *self.factors]))


@dataclass
class Fit:
    """Estimates of one model; arrays follow ``terms``."""

    model: Model
    terms: list[str]
    levels: dict[str, list]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    rank: int
    sse: float
    sst: float
    se: np.ndarray | None = None
    distribution: str = "normal"
    df: int | None = None
    details: dict = field(default_factory=dict)

    @property
    def r_squared(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else float("nan")

    @property
    def adjusted_r_squared(self) -> float:
        spare = self.n - self.rank
        if spare <= 0:
            return float("nan")
        return 1.0 - (1.0 - self.r_squared) * (self.n - 1) / spare

    def table(self) -> list[dict]:
        """One record per term with t value, p value and 95 % interval."""
        if self.se is None:
            raise ValueError("fit a covariance first")
        student = self.distribution == "t"
        critical = student_quantile(0.975, self.df) if student else normal_quantile(0.975)
        rows = []
        for term, b, s in zip(self.terms, self.beta, self.se):
            t = float(b / s) if s > 0 else None
            p = None
            if t is not None:
                p = student_two_sided(t, self.df) if student else normal_two_sided(t)
            rows.append(
                {
                    "term": term,
                    "coefficient": float(b),
                    "std_error": float(s),
                    "t_value": t,
                    "p_value": p,
                    "ci_low": float(b - critical * s),
                    "ci_high": float(b + critical * s),
                }
            )
        return rows


TABLE_SCHEMA = (
    "term string, coefficient double, std_error double, t_value double, "
    "p_value double, ci_low double, ci_high double"
)


def usable_rows(df: DataFrame, model: Model, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Listwise deletion, then only the columns the model needs as doubles."""
    columns = model.source_columns
    complete = df.dropna(subset=columns)
    numbers = {}
    for term in (model.outcome, *model.numeric):
        product = F.lit(1.0)
        for part in term.split(":"):
            product = product * F.col(part).cast("double")
        numbers[term] = product
    aliases = [numbers[model.outcome].alias("_y")]
    aliases += [numbers[t].alias(f"_x{i}") for i, t in enumerate(model.numeric)]
    aliases += [F.col(f).alias(f"_f{i}") for i, f in enumerate(model.factors)]
    return complete.select(*keep, *aliases)


def _numeric_names(model: Model) -> list[str]:
    return [f"_x{i}" for i in range(len(model.numeric))]


def _factor_names(model: Model) -> list[str]:
    return [f"_f{i}" for i in range(len(model.factors))]


def cell_moments(rows: DataFrame, model: Model, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, factor levels, _n, sums, cross sums) of numeric terms and outcome."""
    z = [*_numeric_names(model), "_y"]
    sums = [F.expr(f"sum({a}) AS _s{i}") for i, a in enumerate(z)]
    cross = [
        F.expr(f"sum({z[i]} * {z[j]}) AS _q{i}_{j}")
        for i in range(len(z))
        for j in range(i, len(z))
    ]
    return rows.groupBy(*keys, *_factor_names(model)).agg(
        F.expr("count(1) AS _n"), *sums, *cross
    )


def factor_levels(
    cells: DataFrame, model: Model, max_terms: int = MAX_TERMS
) -> dict[str, list]:
    """Sorted levels per factor, refused beyond ``max_terms`` in total."""
    found: dict[str, list] = {}
    total = 1 + len(model.numeric)
    for name, factor in zip(_factor_names(model), model.factors):
        values = [r[0] for r in cells.select(name).distinct().limit(max_terms + 1).collect()]
        total += max(0, len(values) - 1)
        if total > max_terms:
            raise ValueError(f"more than {max_terms} terms; factor {factor} has too many levels")
        found[factor] = sorted(values)
    return found


def term_names(model: Model, levels: dict[str, list]) -> list[str]:
    names = ["Intercept"]
    for factor in model.factors:
        names += [f"C({factor})[T.{level}]" for level in levels[factor][1:]]
    return names + list(model.numeric)


def _dummies(frame: pd.DataFrame, model: Model, levels: dict[str, list]) -> np.ndarray:
    """Intercept and treatment-coded factor columns of a batch."""
    blocks = [np.ones((len(frame), 1))]
    for name, factor in zip(_factor_names(model), model.factors):
        codes = pd.Categorical(frame[name], categories=levels[factor]).codes
        if (codes < 0).any():
            raise ValueError(f"unknown level of {factor}")
        block = np.zeros((len(frame), max(0, len(levels[factor]) - 1)))
        hit = np.flatnonzero(codes > 0)
        block[hit, codes[hit] - 1] = 1.0
        blocks.append(block)
    return np.hstack(blocks)


def _cells_to_gram(frame: pd.DataFrame, model: Model, levels: dict[str, list]) -> np.ndarray:
    """[X y]'[X y] of the rows summarised by a batch of cells."""
    d = _dummies(frame, model, levels)
    p = len(model.numeric) + 1
    sums = frame[[f"_s{i}" for i in range(p)]].to_numpy(float)
    k = d.shape[1]
    gram = np.zeros((k + p, k + p))
    gram[:k, :k] = d.T @ (d * frame["_n"].to_numpy(float)[:, None])
    gram[:k, k:] = d.T @ sums
    gram[k:, :k] = gram[:k, k:].T
    for i in range(p):
        for j in range(i, p):
            gram[k + i, k + j] = gram[k + j, k + i] = frame[f"_q{i}_{j}"].sum()
    return gram


def _upper(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of a symmetric matrix, row by row."""
    return matrix[np.triu_indices(len(matrix))]


def _as_matrix(values: pd.DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix behind (pos, value) rows of an upper triangle."""
    flat = np.zeros(size * (size + 1) // 2)
    flat[values["pos"].to_numpy()] = values["value"].to_numpy()
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = flat
    return matrix + np.triu(matrix, 1).T


def _sum_matrices(frame: DataFrame, make, keys: Sequence[str], schema_keys: str) -> pd.DataFrame:
    """Fold batches to one matrix per task (and key), then sum them in Spark.

    ``make(batch)`` yields (key tuple, symmetric matrix). The shuffle and the
    driver see the upper triangle of k x k numbers per task and key.
    """

    def fold(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for key, matrix in make(batch):
                    total[key] = total[key] + matrix if key in total else matrix
        for key, matrix in total.items():
            flat = _upper(matrix)
            out = {name: [part] * len(flat) for name, part in zip(keys, key)}
            out["pos"] = np.arange(len(flat), dtype="int64")
            out["value"] = flat
            yield pd.DataFrame(out)

    schema = f"{schema_keys}{', ' if schema_keys else ''}pos long, value double"
    summed = frame.mapInPandas(fold, schema).groupBy(*keys, "pos")
    return summed.agg(F.sum("value").alias("value")).toPandas()


def gram_matrix(cells: DataFrame, model: Model, levels: dict[str, list]) -> np.ndarray:
    size = len(term_names(model, levels)) + 1
    rows = _sum_matrices(
        cells, lambda batch: [((), _cells_to_gram(batch, model, levels))], (), ""
    )
    return _as_matrix(rows, size)


def generalized_inverse(xtx: np.ndarray, tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """Moore-Penrose inverse of X'X and its rank.

    The matrix is scaled to unit diagonal first, which keeps the digits that
    columns of very different size would cost. For a rank-deficient design the
    scaled inverse is projected back on the row space.
    """
    scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
    values, vectors = np.linalg.eigh(xtx / np.outer(scale, scale))
    keep = values > tolerance * max(values.max(), 1e-300)
    directions = vectors[:, keep] / scale[:, None]
    inverse = (directions / values[keep]) @ directions.T
    if not keep.all():
        null = vectors[:, ~keep] / scale[:, None]
        null, _ = np.linalg.qr(null)
        project = np.eye(len(xtx)) - null @ null.T
        inverse = project @ inverse @ project
    return inverse, int(keep.sum())


def solve(gram: np.ndarray, model: Model, levels: dict[str, list]) -> Fit:
    k = gram.shape[0] - 1
    xtx, xty, yty = gram[:k, :k], gram[:k, k], gram[k, k]
    bread, rank = generalized_inverse(xtx)
    beta = bread @ xty
    beta = beta + bread @ (xty - xtx @ beta)
    n = int(round(gram[0, 0]))
    sse = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    sst = float(yty - gram[0, k] ** 2 / n)
    return Fit(model, term_names(model, levels), levels, beta, bread, n, rank, max(sse, 0.0), sst)


def fit_ols(df: DataFrame, model: Model, keep: Sequence[str | Column] = ()) -> tuple[Fit, DataFrame]:
    """Estimates, and the used rows for a second pass."""
    rows = usable_rows(df, model, keep)
    cells = materialize(cell_moments(rows, model), "cells")
    levels = factor_levels(cells, model)
    gram = gram_matrix(cells, model, levels)
    if gram[0, 0] < 1:
        raise ValueError("no complete rows for the model")
    return solve(gram, model, levels), rows


def with_residual(rows: DataFrame, fit: Fit) -> DataFrame:
    """Adds ``_e`` and a level number ``_l<i>`` per factor.

    Factor effects are joined from one row per level. These tables hold at
    most ``MAX_TERMS`` rows, checked when the levels were listed, so they are
    broadcast.
    """
    model = fit.model
    beta = dict(zip(fit.terms, fit.beta.tolist()))
    fitted = [repr(beta["Intercept"]) + "D"]
    for name, term in zip(_numeric_names(model), model.numeric):
        fitted.append(f"{name} * {beta[term]!r}D")
    out = rows
    for i, (name, factor) in enumerate(zip(_factor_names(model), model.factors)):
        kind = rows.schema[name].dataType.simpleString()
        effects = rows.sparkSession.createDataFrame(
            [
                (v, n, beta.get(f"C({factor})[T.{v}]", 0.0))
                for n, v in enumerate(fit.levels[factor])
            ],
            f"{name} {kind}, _l{i} int, _effect{i} double",
        )
        out = out.join(F.broadcast(effects), name)
        fitted.append(f"_effect{i}")
    out = out.withColumn("_e", F.expr(f"_y - ({' + '.join(fitted)})"))
    return out.drop(*[f"_effect{i}" for i in range(len(model.factors))])


def _score_sums(fit: Fit) -> list[Column]:
    """Sum of x*e per term, as aggregates in term order."""
    model = fit.model
    sums = ["_e"]
    for i, factor in enumerate(model.factors):
        sums += [
            f"CASE WHEN _l{i} = {n} THEN _e ELSE 0D END"
            for n in range(1, len(fit.levels[factor]))
        ]
    sums += [f"{x} * _e" for x in _numeric_names(model)]
    return [F.expr(f"sum({s}) AS s{i}") for i, s in enumerate(sums)]


def _meat(scores: DataFrame, size: int) -> dict[str, tuple[np.ndarray, int]]:
    """kind -> (sum of score outer products, number of clusters)."""
    columns = [f"s{i}" for i in range(size)]

    def outer(batch: pd.DataFrame):
        for kind, part in batch.groupby("kind"):
            u = part[columns].to_numpy(float)
            # one extra row and column carry the number of clusters
            padded = np.zeros((size + 1, size + 1))
            padded[:size, :size] = u.T @ u
            padded[size, size] = len(part)
            yield (kind,), padded

    rows = _sum_matrices(scores, outer, ("kind",), "kind string")
    result = {}
    for kind, own in rows.groupby("kind"):
        matrix = _as_matrix(own, size + 1)
        result[kind] = (matrix[:size, :size], int(round(matrix[size, size])))
    return result


def _sandwich(fit: Fit, meat: np.ndarray) -> np.ndarray:
    return fit.bread @ meat @ fit.bread


def _errors(covariance: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(covariance), 0.0))


def _small_sample(groups: int, n: int, k: int) -> float:
    return groups / (groups - 1.0) * (n - 1.0) / (n - k)


def fit_cluster(df: DataFrame, model: Model, cluster: str, correction: bool = True) -> Fit:
    """One-way cluster-robust errors with normal inference."""
    fit, rows = fit_ols(df.where(F.col(cluster).isNotNull()), model, [cluster])
    size = len(fit.terms)
    scores = (
        with_residual(rows, fit)
        .groupBy(F.col(cluster).alias("_g"))
        .agg(*_score_sums(fit))
        .withColumn("kind", F.lit("g"))
    )
    meat, groups = _meat(scores, size)["g"]
    if correction and groups < 2:
        raise ValueError("cluster-robust errors need at least two clusters")
    factor = _small_sample(groups, fit.n, size) if correction else 1.0
    fit.se = _errors(factor * _sandwich(fit, meat))
    fit.details = {"clusters": groups}
    return fit


def fit_two_way_cluster(df: DataFrame, model: Model, first: str, second: str) -> Fit:
    """Two-way clustered errors, t inference on the smaller cluster count.

    The sums per first, per second and per pair of clusters come from one
    aggregation over grouping sets, with one scan and one shuffle of sums.
    """
    known = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    keys = [F.col(first).alias("_a"), F.col(second).alias("_b")]
    fit, rows = fit_ols(known, model, keys)
    size = len(fit.terms)
    sets = [["_a", "_b"], ["_a"], ["_b"]]
    # grouping_id has a bit for each key that is left out
    kind = F.expr("CASE grouping_id() WHEN 0 THEN 'ab' WHEN 1 THEN 'a' ELSE 'b' END AS kind")
    scores = (
        with_residual(rows, fit).groupingSets(sets, "_a", "_b").agg(kind, *_score_sums(fit))
    )
    parts = _meat(scores, size)
    covariance = np.zeros((size, size))
    for kind, sign in (("a", 1.0), ("b", 1.0), ("ab", -1.0)):
        meat, groups = parts[kind]
        if groups < 2:
            raise ValueError("two-way clustering needs at least two clusters each way")
        covariance += sign * _small_sample(groups, fit.n, size) * _sandwich(fit, meat)
    smaller = min(parts["a"][1], parts["b"][1])
    fit.se = _errors(covariance)
    fit.distribution = "t"
    fit.df = max(1, smaller - 1)
    fit.details = {"clusters": [parts["a"][1], parts["b"][1]], "smallest_cluster_count": smaller}
    return fit


def fit_hac(
    df: DataFrame, model: Model, order: Sequence[str], lags: int = 24, chunk: int = 20_000
) -> Fit:
    """Bartlett-weighted HAC errors over row positions, normal inference.

    Rows get their exact position in ``order`` (which must identify a row),
    are cut into chunks of positions, and the last ``lags`` rows of a chunk
    are also given to the next one. Every lag product then lies inside one
    bounded chunk, wherever the row sits in the data.
    """
    if chunk < lags:
        raise ValueError("a chunk must hold at least as many rows as there are lags")
    fit, rows = fit_ols(df, model, order)
    size = len(fit.terms)
    placed = with_positions(with_residual(rows, fit), list(order), rows=fit.n)
    own = F.floor(F.col("_pos") / F.lit(chunk)).cast("bigint")
    tail = F.col("_pos") % chunk >= chunk - lags
    copies = placed.select(
        "_pos",
        "_e",
        *_numeric_names(model),
        *_factor_names(model),
        F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("_chunk"),
    )
    levels = fit.levels
    weights = [1.0 - lag / (lags + 1.0) for lag in range(lags + 1)]

    def lag_products(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pos")
        x = np.hstack(
            [_dummies(frame, model, levels), frame[_numeric_names(model)].to_numpy(float)]
        )
        u = x * frame["_e"].to_numpy(float)[:, None]
        start = int((frame["_pos"].to_numpy() < key[0] * chunk).sum())
        if start == len(u):
            return pd.DataFrame({"pos": [], "value": []})
        lagged = np.zeros_like(u)
        for lag in range(1, lags + 1):
            lagged[lag:] += weights[lag] * u[: len(u) - lag] if lag < len(u) else 0.0
        own_rows, earlier = u[start:], lagged[start:]
        crossed = own_rows.T @ earlier
        meat = _upper(own_rows.T @ own_rows + crossed + crossed.T)
        return pd.DataFrame({"pos": np.arange(len(meat)), "value": meat})

    rows_sum = (
        copies.groupBy("_chunk")
        .applyInPandas(lag_products, "pos long, value double")
        .groupBy("pos")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    fit.se = _errors(_sandwich(fit, _as_matrix(rows_sum, size)))
    fit.details = {"lags": lags}
    return fit


def coefficient_frame(spark, fit: Fit) -> DataFrame:
    """The coefficient table (k rows) as a DataFrame."""
    rows = [tuple(r.values()) for r in fit.table()]
    return spark.createDataFrame(rows, TABLE_SCHEMA)
