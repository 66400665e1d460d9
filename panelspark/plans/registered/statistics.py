"""Regressions, bootstrap, trend and rank correlation.

The oracles use closed forms: a factor is removed by demeaning inside its
levels, two numeric terms are solved from their 2 x 2 cross products, and the
robust errors follow from the demeaned regressors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import aggregates as A
from panelspark.operators.absorbed import absorbed_cluster, absorbed_two_way
from panelspark.operators.bootstrap import BOOTSTRAP_SCHEMA, distributed_bootstrap, wild_cluster_bootstrap
from panelspark.operators.regression import (
    Model,
    coefficient_frame,
    fit_cluster,
    fit_hac,
    fit_ols,
    fit_two_way_cluster,
)
from panelspark.plans import fixtures as X
from panelspark.plans import suites
from panelspark.plans.registered.aggregates import energy_weather_table
from panelspark.plans.registered.scans import overall_sql
from panelspark.plans.registered.spec import query

ROW_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PRICE_MODEL = Model("l_extendedprice", ("l_quantity", "l_discount"), ("ship_month",), "price")
INTERACTION_MODEL = Model(
    "l_extendedprice", ("l_quantity", "l_quantity:high_discount"), ("ship_month",), "interaction"
)


def within_sql(x1: str, x2: str, factor: str, tail: str) -> str:
    """Two numeric terms and one factor: ``r`` has residuals, ``m`` the moments."""
    return f"""
WITH base AS (SELECT *, l_extendedprice AS y, CAST({x1} AS DOUBLE) AS x1, CAST({x2} AS DOUBLE) AS x2,
    {factor} AS f FROM sample),
d AS (SELECT *, y - avg(y) OVER w AS yd, x1 - avg(x1) OVER w AS a, x2 - avg(x2) OVER w AS b
  FROM base WINDOW w AS (PARTITION BY f)),
m0 AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * yd) AS ay, sum(b * yd) AS by_,
    CAST(count(*) AS DOUBLE) AS n, count(DISTINCT f) AS nf, var_pop(y) * count(*) AS sst FROM d),
m AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1,
    (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2, n - 2 - nf AS dof, 2 + nf AS k FROM m0),
r AS (SELECT d.*, yd - b1 * a - b2 * b AS e, (bb * a - ab * b) / det AS z1, (aa * b - ab * a) / det AS z2
  FROM d, m)
{tail}"""


def _terms(first: str, second: str, v1: str, v2: str) -> str:
    return f"""SELECT '{first}' AS term, b1 AS coefficient, sqrt({v1}) AS std_error, b1 / sqrt({v1}) AS t_value
      FROM m, v UNION ALL SELECT '{second}', b2, sqrt({v2}), b2 / sqrt({v2}) FROM m, v"""


_COEFFICIENTS = "term s, coefficient d3, std_error d3, t_value d4"


def _numeric_terms(spark, fit):
    table = coefficient_frame(spark, fit)
    return table.where(F.col("term").isin(*fit.model.numeric))


_ALL_TERMS_SQL = within_sql(
    "l_quantity", "l_discount", "ship_month",
    """, alpha AS (SELECT f, avg(y) - b1 * avg(x1) - b2 * avg(x2) AS a FROM base, m GROUP BY f, b1, b2)
    SELECT CASE WHEN f = 1 THEN 'Intercept' ELSE concat('C(ship_month)[T.', f, ']') END AS term,
      CASE WHEN f = 1 THEN a ELSE a - (SELECT a FROM alpha WHERE f = 1) END AS coefficient FROM alpha
    UNION ALL SELECT 'l_quantity', b1 FROM m UNION ALL SELECT 'l_discount', b2 FROM m""",
)


@query("ols_fixed_effects", "term s, coefficient d3", _ALL_TERMS_SQL, "sample")
def ols_fixed_effects(spark, sf_dir):
    fit, _ = fit_ols(X.regression_sample(spark, sf_dir), PRICE_MODEL)
    rows = list(zip(fit.terms, fit.beta.tolist()))
    return spark.createDataFrame(rows, "term string, coefficient double")


def _cluster_sql(cluster: str, name: str) -> str:
    return (
        f", {name} AS (SELECT sum(s1 * s1) AS q1, sum(s2 * s2) AS q2, CAST(count(*) AS DOUBLE) AS g"
        f" FROM (SELECT sum(z1 * e) AS s1, sum(z2 * e) AS s2 FROM r GROUP BY {cluster}))"
    )


def _corrected(name: str, column: str) -> str:
    return f"{name}.{column} * {name}.g / ({name}.g - 1) * (n - 1) / (n - k)"


@query(
    "ols_cluster",
    _COEFFICIENTS,
    within_sql(
        "l_quantity", "l_discount", "ship_month",
        _cluster_sql("l_suppkey", "g1")
        + f", v AS (SELECT {_corrected('g1', 'q1')} AS v1, {_corrected('g1', 'q2')} AS v2 FROM m, g1) "
        + _terms("l_quantity", "l_discount", "v1", "v2"),
    ),
    "sample",
)
def ols_cluster(spark, sf_dir):
    fit = fit_cluster(X.regression_sample(spark, sf_dir), PRICE_MODEL, "l_suppkey")
    return _numeric_terms(spark, fit)


def _cluster_parts_sql(cluster: str, t: str) -> str:
    """Pair sums of one cluster key (a column list), named with the suffix ``t``."""
    return f""", rg{t} AS (SELECT ROW({cluster}) AS g, sum(z1 * e) AS r1, sum(z2 * e) AS r2 FROM r GROUP BY ALL),
    big{t} AS (SELECT sum(r1 * r1) AS q11, sum(r1 * r2) AS q12, sum(r2 * r2) AS q22, CAST(count(*) AS DOUBLE) AS g
      FROM rg{t}),
    pr{t} AS (SELECT ROW({cluster}) AS g, r.f, sum(e) / any_value(lv.nl) AS a FROM r JOIN lv ON r.f = lv.f GROUP BY ALL),
    prr{t} AS (SELECT pr{t}.g, pr{t}.a, rg{t}.r1, rg{t}.r2 FROM pr{t} JOIN rg{t} ON pr{t}.g = rg{t}.g
      WHERE pr{t}.f = (SELECT f FROM ref)),
    cref{t} AS (SELECT coalesce(sum(a * a), 0) AS s_aa, coalesce(sum(a * r1), 0) AS s_ar1,
      coalesce(sum(a * r2), 0) AS s_ar2 FROM prr{t}),
    per{t} AS (SELECT pr{t}.f, sum(pr{t}.a * pr{t}.a) AS s_ll, sum(pr{t}.a * coalesce(prr{t}.a, 0)) AS s_lref,
        sum(pr{t}.a * rg{t}.r1) AS s_lr1, sum(pr{t}.a * rg{t}.r2) AS s_lr2
      FROM pr{t} JOIN rg{t} ON pr{t}.g = rg{t}.g LEFT JOIN prr{t} ON prr{t}.g = pr{t}.g GROUP BY pr{t}.f),
    fac{t} AS (SELECT big{t}.*, s_aa, s_ar1, s_ar2, g / (g - 1) * (n - 1) / (n - k) AS c FROM big{t}, cref{t}, m)"""


def _absorbed_sql(factor: str, clusters: list[tuple[str, float]], tail: str | None = None) -> str:
    """Every term of a two-term model with clustered errors (signed sum over keys), the factor absorbed.

    Level l's error uses only the (cluster, level) pairs that exist:
    Var(alpha_l - alpha_ref) = sum a_l^2 - 2 sum a_l a_ref + sum a_ref^2 - 2 d.sum a_l r + 2 d.sum a_ref r + d'Rd,
    with a = residual sum / level count, r = S^-1 sum z~ e per cluster and d = zbar_l - zbar_ref.
    """
    parts = "".join(_cluster_parts_sql(cluster, str(t)) for t, (cluster, _) in enumerate(clusters))

    def total(expression: str) -> str:
        return " + ".join(f"({sign!r} * fac{t}.c * ({expression.format(t=t)}))" for t, (_, sign) in enumerate(clusters))

    intercept = total("fac{t}.s_aa - 2 * (ref.m1 * fac{t}.s_ar1 + ref.m2 * fac{t}.s_ar2) + ref.m1 * ref.m1 * fac{t}.q11"
                      " + 2 * ref.m1 * ref.m2 * fac{t}.q12 + ref.m2 * ref.m2 * fac{t}.q22")
    level = total(
        "per{t}.s_ll - 2 * per{t}.s_lref + fac{t}.s_aa - 2 * ((lv.m1 - ref.m1) * per{t}.s_lr1 + (lv.m2 - ref.m2) * per{t}.s_lr2)"
        " + 2 * ((lv.m1 - ref.m1) * fac{t}.s_ar1 + (lv.m2 - ref.m2) * fac{t}.s_ar2)"
        " + (lv.m1 - ref.m1) * (lv.m1 - ref.m1) * fac{t}.q11 + 2 * (lv.m1 - ref.m1) * (lv.m2 - ref.m2) * fac{t}.q12"
        " + (lv.m2 - ref.m2) * (lv.m2 - ref.m2) * fac{t}.q22"
    )
    facs = ", ".join(f"fac{t}" for t in range(len(clusters)))
    pers = " ".join(f"JOIN per{t} ON lv.f = per{t}.f" for t in range(len(clusters)))
    tail = tail or """SELECT term, coefficient, std_error, coefficient / std_error AS t_value,
      coefficient - 1.959963984540054 * std_error AS ci_low, coefficient + 1.959963984540054 * std_error AS ci_high
    FROM terms"""
    return within_sql(
        "l_quantity", "l_discount", factor,
        f""", lv AS (SELECT f, count(*) AS nl, avg(x1) AS m1, avg(x2) AS m2,
        avg(y) - any_value(b1) * avg(x1) - any_value(b2) * avg(x2) AS alpha FROM base, m GROUP BY f),
    ref AS (SELECT * FROM lv WHERE f = (SELECT min(f) FROM lv)){parts},
    terms AS (
      SELECT 'Intercept' AS term, ref.alpha AS coefficient, sqrt(greatest({intercept}, 0)) AS std_error FROM ref, {facs}
      UNION ALL
      SELECT concat('C({factor})[T.', lv.f, ']'), lv.alpha - ref.alpha, sqrt(greatest({level}, 0))
      FROM lv {pers}, ref, {facs} WHERE lv.f <> ref.f
      UNION ALL SELECT 'l_quantity', b1, sqrt(greatest({total("fac{t}.q11")}, 0)) FROM m, {facs}
      UNION ALL SELECT 'l_discount', b2, sqrt(greatest({total("fac{t}.q22")}, 0)) FROM m, {facs})
    {tail}""",
    )


@query(
    "ols_cluster_all_terms",
    "term s, coefficient d4, std_error d4, t_value d5, ci_low d4, ci_high d4",
    _absorbed_sql("ship_month", [("l_suppkey", 1.0)]),
    "sample",
)
def ols_cluster_all_terms(spark, sf_dir):
    """Every term, month effects included, with cluster errors; the month factor absorbed."""
    table = absorbed_cluster(X.regression_sample(spark, sf_dir), PRICE_MODEL, "l_suppkey", absorb="ship_month")
    return table.select("term", "coefficient", "std_error", "t_value", "ci_low", "ci_high")


_TWO_WAY_MODEL = Model("l_extendedprice", ("l_quantity", "l_discount"), ("l_returnflag",), "two_way")


@query(
    "ols_two_way_all_terms",
    "term s, coefficient d4, std_error d4, t_value d5",
    _absorbed_sql(
        "l_returnflag", [("l_suppkey", 1.0), ("ship_month", 1.0), ("l_suppkey, ship_month", -1.0)],
        "SELECT term, coefficient, std_error, coefficient / std_error AS t_value FROM terms",
    ),
    "sample",
)
def ols_two_way_all_terms(spark, sf_dir):
    """Every term with two-way clustered errors (supplier, month), the return flag absorbed."""
    table = absorbed_two_way(X.regression_sample(spark, sf_dir), _TWO_WAY_MODEL, "l_suppkey", "ship_month",
                             absorb="l_returnflag")
    return table.select("term", "coefficient", "std_error", "t_value")


@query(
    "ols_two_way_cluster",
    _COEFFICIENTS,
    within_sql(
        "l_quantity", "l_discount", "l_returnflag",
        _cluster_sql("l_suppkey", "g1")
        + _cluster_sql("ship_month", "g2")
        + _cluster_sql("l_suppkey, ship_month", "g12")
        + ", v AS (SELECT "
        + ", ".join(
            f"greatest({_corrected('g1', q)} + {_corrected('g2', q)} - {_corrected('g12', q)}, 0) AS {v}"
            for q, v in (("q1", "v1"), ("q2", "v2"))
        )
        + " FROM m, g1, g2, g12) "
        + _terms("l_quantity", "l_discount", "v1", "v2"),
    ),
    "sample",
)
def ols_two_way_cluster(spark, sf_dir):
    sample = X.regression_sample(spark, sf_dir)
    return _numeric_terms(
        spark, fit_two_way_cluster(sample, _TWO_WAY_MODEL, "l_suppkey", "ship_month")
    )


def _hac_sum(u: str) -> str:
    lags = " + ".join(
        f"{2 * (1 - lag / 25.0)!r} * coalesce(sum({u} * {u}_{lag}), 0)" for lag in range(1, 25)
    )
    return f"sum({u} * {u}) + {lags}"


@query(
    "ols_hac",
    _COEFFICIENTS,
    within_sql(
        "l_quantity", "l_discount", "ship_month",
        ", u AS (SELECT u1, u2, "
        + ", ".join(
            f"lag({u}, {lag}) OVER w AS {u}_{lag}" for u in ("u1", "u2") for lag in range(1, 25)
        )
        + f" FROM (SELECT *, z1 * e AS u1, z2 * e AS u2 FROM r) WINDOW w AS (ORDER BY {', '.join(ROW_ORDER)}))"
        + f", v AS (SELECT {_hac_sum('u1')} AS v1, {_hac_sum('u2')} AS v2 FROM u) "
        + _terms("l_quantity", "l_discount", "v1", "v2"),
    ),
    "sample",
)
def ols_hac(spark, sf_dir):
    fit = fit_hac(X.regression_sample(spark, sf_dir), PRICE_MODEL, ROW_ORDER)
    return _numeric_terms(spark, fit)


@query(
    "regime_interactions",
    _COEFFICIENTS,
    within_sql(
        "l_quantity", "l_quantity * high_discount", "ship_month",
        _cluster_sql("l_suppkey", "g1")
        + f", v AS (SELECT {_corrected('g1', 'q1')} AS v1, {_corrected('g1', 'q2')} AS v2 FROM m, g1) "
        + _terms("l_quantity", "l_quantity:high_discount", "v1", "v2"),
    ),
    "sample",
)
def regime_interactions(spark, sf_dir):
    fit = fit_cluster(X.regression_sample(spark, sf_dir), INTERACTION_MODEL, "l_suppkey")
    return _numeric_terms(spark, fit)


@query(
    "model_summary",
    "n i, r_squared d8, adjusted_r_squared d8",
    within_sql(
        "l_quantity", "l_discount", "ship_month",
        """SELECT any_value(n) AS n, 1 - sum(e * e) / any_value(sst) AS r_squared,
             1 - (sum(e * e) / any_value(sst)) * (any_value(n) - 1) / any_value(dof) AS adjusted_r_squared
           FROM r, m""",
    ),
    "sample",
)
def model_summary(spark, sf_dir):
    fit, _ = fit_ols(X.regression_sample(spark, sf_dir), PRICE_MODEL)
    row = (fit.n, float(fit.r_squared), float(fit.adjusted_r_squared))
    return spark.createDataFrame([row], "n long, r_squared double, adjusted_r_squared double")


_BOOTSTRAP_SQL = """
WITH d AS (SELECT supplier_group AS g, ship_month AS f,
    l_extendedprice - avg(l_extendedprice) OVER w AS yd, l_quantity - avg(l_quantity) OVER w AS xd
  FROM sample WINDOW w AS (PARTITION BY ship_month)),
m AS (SELECT sum(xd * xd) AS s, sum(xd * yd) / sum(xd * xd) AS b, count(*) AS n, count(DISTINCT g) AS groups FROM d),
cell AS (SELECT g, f, sum(yd) AS ysum, sum(xd / s) AS zsum FROM d, m GROUP BY g, f),
size AS (SELECT f, count(*) AS nf FROM d GROUP BY f),
part AS (SELECT g, sum(xd / s * yd) AS p, sum(xd / s * xd) AS q, sum(xd / s * (yd - b * xd)) AS score
  FROM d, m GROUP BY g),
observed AS (SELECT any_value(b) AS b, sqrt(sum(score * score)) AS se, any_value(b) / sqrt(sum(score * score)) AS t
  FROM part, m),
signs AS (SELECT i, g, CASE WHEN (i >> g) & 1 = 1 THEN 1.0 ELSE -1.0 END AS w
  FROM (SELECT unnest(range(64)) AS i), (SELECT DISTINCT CAST(g AS BIGINT) AS g FROM part)),
means AS (SELECT i, c.f, sum(w * ysum) / any_value(nf) AS v FROM signs JOIN cell c USING (g)
  JOIN size ON size.f = c.f GROUP BY i, c.f),
slopes AS (SELECT i, sum(w * p) AS beta FROM signs JOIN part USING (g) GROUP BY i),
shift AS (SELECT i, g, sum(zsum * v) AS moved FROM cell JOIN means ON means.f = cell.f GROUP BY i, g),
draws AS (SELECT i, any_value(beta) / sqrt(sum((w * p - moved - beta * q) ** 2)) AS t
  FROM signs JOIN part USING (g) JOIN slopes USING (i) JOIN shift USING (i, g) GROUP BY i)
SELECT 'l_quantity' AS target, any_value(b) AS coefficient, any_value(se) AS cluster_se_uncorrected,
  any_value(o.t) AS observed_t,
  (1 + count(*) FILTER (abs(draws.t) >= abs(o.t) * (1 - 1e-9))) / 65.0 AS wild_bootstrap_p_value,
  quantile_cont(draws.t, 0.025) AS bootstrap_t_2_5pct, quantile_cont(draws.t, 0.975) AS bootstrap_t_97_5pct,
  (SELECT n FROM m) AS observations, (SELECT groups FROM m) AS clusters, count(*) AS repetitions
FROM draws, observed o"""


def _bootstrap(spark, sf_dir, exact):
    model = Model("l_extendedprice", ("l_quantity",), ("ship_month",))
    if not exact:
        model = PRICE_MODEL
    if exact:
        records = wild_cluster_bootstrap(
            X.regression_sample(spark, sf_dir), model, "supplier_group", list(model.numeric), exact=True,
        )
    else:
        records = distributed_bootstrap(X.regression_sample(spark, sf_dir), model, "supplier_group", list(model.numeric))
    return spark.createDataFrame([tuple(r.values()) for r in records], BOOTSTRAP_SCHEMA)


@query(
    "wild_cluster_bootstrap",
    "target s, coefficient d4, cluster_se_uncorrected d4, observed_t d5, wild_bootstrap_p_value d, "
    "bootstrap_t_2_5pct d5, bootstrap_t_97_5pct d5, observations i, clusters i, repetitions i",
    _BOOTSTRAP_SQL,
    "sample",
)
def bootstrap_exact(spark, sf_dir):
    """Every sign vector of six clusters."""
    return _bootstrap(spark, sf_dir, exact=True)


@query(
    "wild_cluster_bootstrap_drawn",
    "outcome s, target s, coefficient d, cluster_se_uncorrected d, observed_t d, "
    "wild_bootstrap_p_value d, bootstrap_t_2_5pct d, bootstrap_t_50pct d, bootstrap_t_97_5pct d, "
    "observations i, clusters i, repetitions i, seed i",
)
def bootstrap_drawn(spark, sf_dir):
    """999 drawn sign vectors, two targets."""
    return _bootstrap(spark, sf_dir, exact=False)


@query(
    "horizon_trend",
    "variable s, variable_label s, horizon_bins i, mae_slope_per_hour d8, mae_slope_per_24_hours d, "
    "horizon_mae_correlation d, interpretation s",
    f"""SELECT variable, any_value(variable_label) AS variable_label, count(*) AS horizon_bins,
          regr_slope(mae, horizon_bin_start_hours) AS mae_slope_per_hour,
          regr_slope(mae, horizon_bin_start_hours) * 24 AS mae_slope_per_24_hours,
          corr(horizon_bin_start_hours, mae) AS horizon_mae_correlation,
          CASE WHEN regr_slope(mae, horizon_bin_start_hours) > 0 THEN 'descriptive upward MAE trend'
            ELSE 'no descriptive upward MAE trend' END AS interpretation
        FROM ({overall_sql("horizon_bin, horizon_bin_start_hours")})
        WHERE mae IS NOT NULL GROUP BY variable HAVING count(*) >= 2""",
    "errors",
)
def horizon_trend(spark, sf_dir):
    metrics = A.error_metrics(
        X.forecast_errors(spark, sf_dir), ["horizon_bin", "horizon_bin_start_hours"]
    )
    return A.horizon_trend(metrics)


RANKED = [
    "price_day_ahead_eur_mwh",
    "renewable_share",
    "load_actual_mw",
    "load_forecast_error_mw",
    "temperature_2m_c_mean",
    "wind_speed_10m_kmh_mean",
    "precipitation_mm_mean",
]


def _spearman_sql() -> str:
    parts = []
    for x in RANKED:
        for y in RANKED:
            parts.append(
                f"SELECT '{x}' AS column_x, '{y}' AS column_y, count(*) AS n, corr(rx, ry) AS spearman FROM ("
                " SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,"
                "   rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry"
                f" FROM (SELECT {x} AS x, {y} AS y FROM energy_weather WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"
            )
    return " UNION ALL ".join(parts)


@query(
    "spearman_matrix",
    "column_x s, column_y s, n i, spearman d",
    _spearman_sql(),
    "energy_weather",
)
def spearman_matrix(spark, sf_dir):
    return A.spearman_matrix(energy_weather_table(spark, sf_dir), RANKED)


_SUMMARY = "model s, outcome s, status s, n i, r_squared d, adjusted_r_squared d, inference_df i"
_TABLE = (
    "model s, outcome s, term s, coefficient d, std_error d, t_value d, p_value d, ci_low d, "
    "ci_high d, n i, r_squared d"
)


@query("model_suite", _SUMMARY)
def model_suite(spark, sf_dir):
    """Four two-way clustered models over zones and vintages."""
    return suites.multi_zone_suite(X.impact_panel(spark, sf_dir))[1]


@query("model_suite_coefficients", _TABLE)
def model_suite_coefficients(spark, sf_dir):
    return suites.multi_zone_suite(X.impact_panel(spark, sf_dir))[0]


@query("model_suite_multi_vintage", _SUMMARY)
def model_suite_multi_vintage(spark, sf_dir):
    return suites.multi_vintage_suite(X.zone_impact_panel(spark, sf_dir))[1]


@query("model_suite_single_zone", _SUMMARY)
def model_suite_single_zone(spark, sf_dir):
    return suites.single_zone_suite(X.zone_impact_panel(spark, sf_dir))[1]


@query("model_suite_energy_weather", _SUMMARY)
def model_suite_energy_weather(spark, sf_dir):
    return suites.energy_weather_suite(X.energy_weather(spark, sf_dir))[1]


@query("model_suite_zone_panel", _TABLE)
def model_suite_zone_panel(spark, sf_dir):
    return suites.zone_panel_suite(X.zone_panel(spark, sf_dir))[0]
