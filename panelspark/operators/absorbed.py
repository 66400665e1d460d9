"""Least squares with the widest factor absorbed by block elimination.

Write the design as [D Z]: D holds one indicator per level l of the absorbed
factor, Z the other terms (other factors' treatment dummies and numeric terms,
no intercept). D'D is diagonal (the level counts n_l), so it is divided out
level by level: each row is demeaned inside its level (z~ = z - mean_l z,
y~ = y - mean_l y), and the Schur complement S = Z'Z - Z'D (D'D)^-1 D'Z is the
cross product of the demeaned rows. Only S and Z~'y~, (k_z + 1)^2 numbers, reach
the driver; the number of levels has no limit. beta_Z = S^- Z~'y~, the level
means are alpha_l = mean_l y - mean_l z . beta_Z, and the residual is
e = y~ - z~ . beta_Z.

Robust errors for one cluster key (two-way: V_a + V_b - V_ab) follow from the
blocks of the inverse without forming it. With E_gl the residual sum of
cluster g in level l, a_gl = E_gl / n_l and r_g = S^- sum_{i in g} z~_i e_i, the
score projection of level l is c_gl = a_gl - zbar_l . r_g. So

    Var(alpha_l)  = sum_g a_gl^2 - 2 sum_g a_gl (zbar_l . r_g) + zbar_l' R zbar_l,   R = sum_g r_g r_g'

and the covariance with the reference level needs sum_g a_gl a_g,ref and the
vector sum_g a_g,ref r_g. Each sum over g runs only over clusters that hold the
level: one row per (cluster, level) pair, joined to r_g and summed per level,
all in Spark. The reported terms are the model's treatment coding: Intercept =
alpha_ref, C(f)[T.l] = alpha_l - alpha_ref, then the other terms.

Rows with a null in a model column or a cluster key are left out (listwise).
The first level in sort order is the reference. Degrees of freedom count every
level: k = number of levels + rank-free columns of Z.
"""

from __future__ import annotations

from collections.abc import Sequence

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
from panelspark.operators.regression import (
    TABLE_SCHEMA,
    Model,
    _factor_names,
    _numeric_names,
    _sum_matrices,
    _as_matrix,
    cell_moments,
    factor_levels,
    generalized_inverse,
    usable_rows,
)
from panelspark.session import materialize


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _literal(vector: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector]) if len(vector) else F.array().cast("array<double>")


def _quadratic(vector: Column, matrix: np.ndarray) -> Column:
    """vector' M vector for a literal matrix, as a Spark expression."""
    rows = [_dot(vector, _literal(matrix[j])) * F.element_at(vector, j + 1) for j in range(len(matrix))]
    total = F.lit(0.0)
    for term in rows:
        total = total + term
    return total


def _bilinear(left: Column, matrix: np.ndarray, right: np.ndarray) -> Column:
    return _dot(left, _literal(matrix @ right))


class AbsorbedFit:
    """Estimates of a model whose widest factor was absorbed; level results stay in Spark."""

    def __init__(self, df: DataFrame, model: Model, absorb: str, keys: Sequence[str]):
        if absorb not in model.factors:
            raise ValueError(f"{absorb} is not a factor of the model")
        self.model, self.absorb = model, absorb
        rows = usable_rows(df, model, [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        position = model.factors.index(absorb)
        self.level = _factor_names(model)[position]
        others = Model(model.outcome, model.numeric, tuple(f for f in model.factors if f != absorb))
        other_names = [n for i, n in enumerate(_factor_names(model)) if i != position]
        reduced = rows.select("_y", *_numeric_names(model), *[F.col(n).alias(f"_f{j}") for j, n in enumerate(other_names)])
        self.other_levels = factor_levels(cell_moments(reduced, others), others) if other_names else {}
        z_parts, self.z_terms = [], []
        for name, factor in zip(other_names, [f for f in model.factors if f != absorb]):
            for value in self.other_levels[factor][1:]:
                z_parts.append(F.when(F.col(name) == F.lit(value), 1.0).otherwise(0.0))
                self.z_terms.append(f"C({factor})[T.{value}]")
        z_parts += [F.col(x) for x in _numeric_names(model)]
        self.z_terms += list(model.numeric)
        kz = self.kz = len(z_parts)
        z = F.array(*z_parts).cast("array<double>") if z_parts else F.array().cast("array<double>")
        self.keys = [f"_k{i}" for i in range(len(keys))]
        base = rows.select(*self.keys, F.col(self.level).alias("_lv"), "_y", z.alias("_z"))
        sums = [F.sum(F.element_at("_z", j + 1)).alias(f"_zs{j}") for j in range(kz)]
        levels = base.groupBy("_lv").agg(
            F.count(F.lit(1)).alias("_nl"), F.sum("_y").alias("_ys"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), *sums
        )
        zbar = F.array(*[F.col(f"_zs{j}") / F.col("_nl") for j in range(kz)]) if kz else F.array().cast("array<double>")
        self.levels = materialize(
            levels.select("_lv", "_nl", (F.col("_ys") / F.col("_nl")).alias("_ybar"), "_ys", "_yy", zbar.alias("_zbar")),
            "absorbed-levels",
        )
        totals = self.levels.agg(F.sum("_nl"), F.sum("_ys"), F.sum("_yy"), F.count(F.lit(1)), F.min("_lv")).first()
        if not totals[0]:
            raise ValueError("no complete rows for the model")
        self.n, self.n_levels, self.reference = int(totals[0]), int(totals[3]), totals[4]
        self.sst = float(totals[2] - totals[1] ** 2 / self.n)
        tilde = F.zip_with("_z", "_zbar", lambda a, b: a - b)
        self.demeaned = materialize(
            base.join(self.levels.select("_lv", "_ybar", "_zbar"), "_lv").select(
                *self.keys, "_lv", tilde.alias("_zt"), (F.col("_y") - F.col("_ybar")).alias("_yt")
            ),
            "absorbed-rows",
        )
        gram = self._gram()
        s, b, yy = gram[:kz, :kz], gram[:kz, kz], gram[kz, kz]
        self.s_inverse, rank = generalized_inverse(s) if kz else (np.zeros((0, 0)), 0)
        self.beta = self.s_inverse @ b if kz else np.zeros(0)
        if kz:
            self.beta = self.beta + self.s_inverse @ (b - s @ self.beta)
        self.sse = max(float(yy - 2 * self.beta @ b + self.beta @ s @ self.beta), 0.0)
        self.k = self.n_levels + rank
        beta = _literal(self.beta)
        self.residuals = self.demeaned.withColumn("_e", F.col("_yt") - _dot(F.col("_zt"), beta))
        self.alpha = self.levels.select("_lv", "_nl", "_zbar", (F.col("_ybar") - _dot(F.col("_zbar"), beta)).alias("_alpha"))
        self.reference_zbar = np.array(self.alpha.where(F.col("_lv") == F.lit(self.reference)).first()["_zbar"], dtype=float)

    def _gram(self) -> np.ndarray:
        kz = self.kz

        def make(batch: pd.DataFrame):
            zt = np.array(batch["_zt"].tolist(), dtype=float).reshape(len(batch), kz)
            full = np.hstack([zt, batch["_yt"].to_numpy(float)[:, None]])
            yield (), full.T @ full

        rows = _sum_matrices(self.demeaned.select("_zt", "_yt"), make, (), "")
        return _as_matrix(rows, kz + 1)

    def cluster_parts(self, key: Sequence[str]) -> tuple[np.ndarray, DataFrame, int]:
        """(R, per level (var_l, cov_l with the reference), number of clusters) for one cluster key (columns)."""
        kz, s_inverse = self.kz, self.s_inverse
        score = F.transform("_zt", lambda v: v * F.col("_e"))
        per_cluster = self.residuals.groupBy(F.struct(*key).alias("_g")).agg(
            *[F.sum(F.element_at(score, j + 1)).alias(f"_u{j}") for j in range(kz)]
        )
        u = F.array(*[F.col(f"_u{j}") for j in range(kz)]) if kz else F.array().cast("array<double>")
        clusters = materialize(
            per_cluster.select("_g", F.array(*[_dot(u, _literal(s_inverse[j])) for j in range(kz)]).cast("array<double>").alias("_r")),
            "absorbed-clusters",
        )

        def outer(batch: pd.DataFrame):
            r = np.array(batch["_r"].tolist(), dtype=float).reshape(len(batch), kz)
            padded = np.zeros((kz + 1, kz + 1))
            padded[:kz, :kz] = r.T @ r
            padded[kz, kz] = len(batch)
            yield (), padded

        summed = _as_matrix(_sum_matrices(clusters, outer, (), ""), kz + 1)
        r_matrix, groups = summed[:kz, :kz], int(round(summed[kz, kz]))
        pairs = (
            self.residuals.groupBy(F.struct(*key).alias("_g"), "_lv").agg(F.sum("_e").alias("_E"))
            .join(self.alpha.select("_lv", "_nl", "_zbar"), "_lv")
            .withColumn("_a", F.col("_E") / F.col("_nl"))
        )
        pairs = materialize(pairs.join(clusters, "_g").select("_g", "_lv", "_a", "_zbar", "_r"), "absorbed-pairs")
        at_reference = pairs.where(F.col("_lv") == F.lit(self.reference)).select("_g", F.col("_a").alias("_aref"))
        q_reference = pairs.where(F.col("_lv") == F.lit(self.reference)).agg(
            *[F.sum(F.col("_a") * F.element_at("_r", j + 1)) for j in range(kz)]
        ).first()
        q_reference = np.array([v or 0.0 for v in q_reference], dtype=float) if kz else np.zeros(0)
        zref = _literal(self.reference_zbar)
        sums = (
            pairs.join(at_reference, "_g", "left")
            .groupBy("_lv")
            .agg(
                F.sum(F.col("_a") * F.col("_a")).alias("_p"),
                F.sum(F.col("_a") * _dot(F.col("_zbar"), F.col("_r"))).alias("_zq"),
                F.sum(F.col("_a") * F.coalesce(F.col("_aref"), F.lit(0.0))).alias("_x"),
                F.sum(F.col("_a") * _dot(zref, F.col("_r"))).alias("_rq"),
            )
        )
        zbar = F.col("_zbar")
        per_level = self.alpha.select("_lv", "_zbar").join(sums, "_lv", "left").na.fill(0.0, ["_p", "_zq", "_x", "_rq"])
        per_level = per_level.select(
            "_lv",
            (F.col("_p") - 2 * F.col("_zq") + _quadratic(zbar, r_matrix)).alias("_var"),
            (F.col("_x") - F.col("_rq") - _dot(zbar, _literal(q_reference))
             + _bilinear(zbar, r_matrix, self.reference_zbar)).alias("_cov"),
        )
        return r_matrix, per_level, groups

    def table(self, parts: Sequence[tuple[Sequence[str], float]], distribution: str = "normal", df: int | None = None) -> DataFrame:
        """The coefficient table: (cluster key, weight) pairs are summed, weight times small-sample factor."""
        kz = self.kz
        z_covariance = np.zeros((kz, kz))
        level_parts = []
        for key, sign in parts:
            r_matrix, per_level, groups = self.cluster_parts(key)
            if groups < 2:
                raise ValueError("cluster-robust errors need at least two clusters")
            factor = sign * groups / (groups - 1.0) * (self.n - 1.0) / (self.n - self.k)
            z_covariance += factor * r_matrix
            level_parts.append(per_level.select("_lv", (F.col("_var") * factor).alias("_var"), (F.col("_cov") * factor).alias("_cov")))
        combined = level_parts[0]
        for part in level_parts[1:]:
            combined = combined.unionByName(part)
        combined = materialize(combined.groupBy("_lv").agg(F.sum("_var").alias("_var"), F.sum("_cov").alias("_cov")), "absorbed-variances")
        var_reference = combined.where(F.col("_lv") == F.lit(self.reference)).first()["_var"]
        alpha_reference = self.alpha.where(F.col("_lv") == F.lit(self.reference)).first()["_alpha"]
        spark = self.levels.sparkSession
        factor_name = f"C({self.absorb})[T."
        level_rows = (
            self.alpha.join(combined, "_lv")
            .where(F.col("_lv") != F.lit(self.reference))
            .select(
                F.concat(F.lit(factor_name), F.col("_lv").cast("string"), F.lit("]")).alias("term"),
                (F.col("_alpha") - F.lit(alpha_reference)).alias("coefficient"),
                F.sqrt(F.greatest(F.col("_var") + F.lit(var_reference) - 2 * F.col("_cov"), F.lit(0.0))).alias("std_error"),
                F.lit(1).alias("_order"), F.col("_lv").cast("string").alias("_key"),
            )
        )
        head = [("Intercept", float(alpha_reference), float(np.sqrt(max(var_reference, 0.0))), 0, "")]
        head += [
            (term, float(b), float(np.sqrt(max(z_covariance[j, j], 0.0))), 2, f"{j:09d}")
            for j, (term, b) in enumerate(zip(self.z_terms, self.beta))
        ]
        fixed = spark.createDataFrame(head, "term string, coefficient double, std_error double, _order int, _key string")
        terms = fixed.unionByName(level_rows)
        student = distribution == "t"
        critical = student_quantile(0.975, df) if student else normal_quantile(0.975)

        def inference(batches):
            for batch in batches:
                se = batch["std_error"].to_numpy(float)
                b = batch["coefficient"].to_numpy(float)
                t = np.where(se > 0, b / np.where(se > 0, se, 1.0), np.nan)
                p = [None if np.isnan(v) else (student_two_sided(v, df) if student else normal_two_sided(v)) for v in t]
                yield pd.DataFrame({
                    "term": batch["term"], "coefficient": b, "std_error": se,
                    "t_value": np.where(np.isnan(t), None, t), "p_value": p,
                    "ci_low": b - critical * se, "ci_high": b + critical * se,
                    "_order": batch["_order"], "_key": batch["_key"],
                })

        return terms.mapInPandas(inference, f"{TABLE_SCHEMA}, _order int, _key string")


def widest_factor(df: DataFrame, model: Model) -> str:
    """The factor with most levels among complete rows."""
    rows = usable_rows(df, model)
    counts = rows.agg(*[F.countDistinct(n).alias(n) for n in _factor_names(model)]).first()
    return max(zip(model.factors, counts), key=lambda pair: pair[1])[0]


def absorbed_cluster(df: DataFrame, model: Model, cluster: str, absorb: str | None = None) -> DataFrame:
    """One-way cluster-robust table (normal inference), widest factor absorbed."""
    absorb = absorb or widest_factor(df, model)
    fit = AbsorbedFit(df.where(F.col(cluster).isNotNull()), model, absorb, [cluster])
    return fit.table([(["_k0"], 1.0)]).orderBy("_order", "_key").drop("_order", "_key")


def absorbed_two_way(df: DataFrame, model: Model, first: str, second: str, absorb: str | None = None) -> DataFrame:
    """Two-way clustered table, t inference on the smaller cluster count, widest factor absorbed."""
    absorb = absorb or widest_factor(df, model)
    known = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    fit = AbsorbedFit(known, model, absorb, [first, second])
    smaller = min(
        fit.residuals.select("_k0").distinct().count(), fit.residuals.select("_k1").distinct().count()
    )
    table = fit.table([(["_k0"], 1.0), (["_k1"], 1.0), (["_k0", "_k1"], -1.0)], "t", max(1, smaller - 1))
    return table.orderBy("_order", "_key").drop("_order", "_key")
