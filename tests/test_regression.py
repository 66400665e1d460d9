import numpy as np
import pandas as pd
import pytest

from panelspark.operators.bootstrap import sign_weights, wild_cluster_bootstrap
from panelspark.operators.positions import with_positions
from panelspark.operators.regression import (
    Model,
    factor_levels,
    fit_cluster,
    fit_hac,
    fit_ols,
    fit_two_way_cluster,
    generalized_inverse,
)
from panelspark.plans.suites import run_suite

MODEL = Model("y", ("x1", "x2", "x1:r"), ("f", "h"), "m")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 900
    frame = pd.DataFrame(
        {
            "t": rng.permutation(n),
            "x1": rng.normal(5, 2, n),
            "x2": rng.normal(0, 1000, n),
            "r": rng.integers(0, 2, n),
            "f": rng.choice(["c", "a", "b"], n, p=[0.6, 0.3, 0.1]),
            "h": rng.integers(0, 4, n),
            "g1": rng.integers(0, 40, n),
            "g2": rng.choice(7, n, p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]),
        }
    )
    frame["y"] = 2 * frame.x1 - 0.01 * frame.x2 + (frame.f == "b") + frame.h + rng.normal(0, 1, n)
    frame.loc[rng.random(n) < 0.05, "x1"] = np.nan
    return frame


@pytest.fixture(scope="module")
def dense(sample):
    used = sample.dropna().reset_index(drop=True)
    columns = [np.ones(len(used))]
    columns += [(used.f == v) * 1.0 for v in ("b", "c")] + [(used.h == v) * 1.0 for v in (1, 2, 3)]
    columns += [used.x1, used.x2, used.x1 * used.r]
    x = np.column_stack(columns)
    beta = np.linalg.lstsq(x, used.y, rcond=None)[0]
    residual = used.y.to_numpy() - x @ beta
    return used, x, beta, residual, np.linalg.inv(x.T @ x)


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample).repartition(3).cache()


def clustered(dense, labels):
    used, x, _, e, bread = dense
    codes = pd.factorize(labels)[0]
    groups = codes.max() + 1
    score = np.zeros((groups, x.shape[1]))
    np.add.at(score, codes, x * e[:, None])
    n, k = x.shape
    return groups / (groups - 1) * (n - 1) / (n - k) * bread @ (score.T @ score) @ bread


def test_estimates_and_terms(frame, dense):
    fit, _ = fit_ols(frame, MODEL)
    used, x, beta, e, _ = dense
    assert fit.terms == [
        "Intercept", "C(f)[T.b]", "C(f)[T.c]", "C(h)[T.1]", "C(h)[T.2]", "C(h)[T.3]", "x1", "x2", "x1:r"
    ]
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-8)
    r2 = 1 - (e @ e) / ((used.y - used.y.mean()) ** 2).sum()
    assert fit.r_squared == pytest.approx(r2, abs=1e-10)
    assert (fit.n, fit.rank) == (len(used), 9)


def test_one_way_cluster(frame, dense):
    fit = fit_cluster(frame, MODEL, "g2")
    np.testing.assert_allclose(fit.se, np.sqrt(np.diag(clustered(dense, dense[0].g2))), rtol=1e-7)
    assert fit.details["clusters"] == 7


def test_two_way_cluster(frame, dense):
    fit = fit_two_way_cluster(frame, MODEL, "g1", "g2")
    used = dense[0]
    pair = used.g1.astype(str) + "/" + used.g2.astype(str)
    v = clustered(dense, used.g1) + clustered(dense, used.g2) - clustered(dense, pair)
    np.testing.assert_allclose(fit.se, np.sqrt(np.maximum(np.diag(v), 0)), rtol=1e-6, atol=1e-12)
    assert (fit.df, fit.distribution) == (6, "t")


@pytest.mark.parametrize("chunk", [24, 100, 20_000])
def test_hac_for_any_chunk(frame, dense, chunk):
    fit = fit_hac(frame, MODEL, ["t"], lags=24, chunk=chunk)
    used, x, _, e, bread = dense
    u = (x * e[:, None])[np.argsort(used.t.to_numpy())]
    meat = u.T @ u
    for lag in range(1, 25):
        gamma = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 25) * (gamma + gamma.T)
    np.testing.assert_allclose(fit.se, np.sqrt(np.diag(bread @ meat @ bread)), rtol=1e-7)


def test_rank_deficient_design_is_minimum_norm(spark, sample, dense):
    copied = sample.assign(x3=sample.x1 * 2, zero=0.0)
    model = Model("y", ("x1", "x3", "zero"), ("f",))
    fit, _ = fit_ols(spark.createDataFrame(copied), model)
    used = copied.dropna()
    x = np.column_stack(
        [np.ones(len(used)), used.f == "b", used.f == "c", used.x1, used.x3, used.zero]
    ).astype(float)
    np.testing.assert_allclose(fit.beta, np.linalg.pinv(x) @ used.y, atol=1e-8)
    assert fit.rank == 4


def test_generalized_inverse_is_moore_penrose():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    x = np.column_stack([x, x[:, 0] - x[:, 1], np.zeros(50)])
    inverse, rank = generalized_inverse(x.T @ x)
    np.testing.assert_allclose(inverse, np.linalg.pinv(x.T @ x), atol=1e-10)
    assert rank == 4


def test_row_order_does_not_matter(frame):
    a = fit_cluster(frame, MODEL, "g2")
    b = fit_cluster(frame.orderBy("x2").repartition(5), MODEL, "g2")
    np.testing.assert_allclose(a.se, b.se, rtol=1e-9)


def test_too_many_levels_are_refused(spark):
    cells = spark.range(50).selectExpr("id AS _f0")
    with pytest.raises(ValueError, match="too many levels"):
        factor_levels(cells, Model("y", (), ("id",)), max_terms=20)


def test_positions_split_a_repeated_leading_key(spark):
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 7, id % 50) AS a", "id AS b")
    got = with_positions(rows, ["a", "b"]).toPandas().sort_values("_pos")
    assert got._pos.tolist() == list(range(1000))
    assert got[["a", "b"]].apply(tuple, axis=1).is_monotonic_increasing


def row_level_bootstrap(sample, target, reps, seed):
    used = sample.dropna()
    x = np.column_stack([np.ones(len(used)), used.x1, used.x2])
    y, groups = used.y.to_numpy(), used.g2.to_numpy()
    names = np.unique(groups)
    inverse = np.linalg.pinv(x.T @ x)

    def t_value(outcome):
        beta = inverse @ x.T @ outcome
        e = outcome - x @ beta
        meat = sum(np.outer(s, s) for s in (x[groups == g].T @ e[groups == g] for g in names))
        return beta[target] / np.sqrt((inverse @ meat @ inverse)[target, target])

    kept = [i for i in range(3) if i != target]
    beta_r = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
    fitted = x[:, kept] @ beta_r
    rng = np.random.default_rng(seed)
    draws = []
    for _ in range(reps):
        w = dict(zip(names, rng.choice(np.array([-1.0, 1.0]), size=len(names))))
        draws.append(t_value(fitted + np.vectorize(w.get)(groups) * (y - fitted)))
    return t_value(y), np.array(draws)


def test_bootstrap_matches_row_level(spark, sample, frame):
    record = wild_cluster_bootstrap(frame, Model("y", ("x1", "x2")), "g2", ["x2"], reps=60, seed=4)[0]
    t, draws = row_level_bootstrap(sample, 2, 60, 4)
    assert record["observed_t"] == pytest.approx(t, rel=1e-8)
    p = (1 + (np.abs(draws) >= abs(t) * (1 - 1e-9)).sum()) / 61
    assert record["wild_bootstrap_p_value"] == pytest.approx(p)
    assert record["bootstrap_t_2_5pct"] == pytest.approx(np.quantile(draws, 0.025), rel=1e-7)


def test_exact_signs():
    signs = sign_weights(0, 3, 0, exact=True)
    assert len({tuple(s) for s in signs}) == 8
    with pytest.raises(ValueError):
        sign_weights(0, 40, 0, exact=True)


def test_suite_gates(spark, frame):
    models = [
        Model("y", ("x1",), (), "good"),
        Model("few", ("x1",), (), "small"),
        Model("y", ("none",), (), "empty"),
    ]
    data = frame.selectExpr("*", "IF(t < 30, y, NULL) AS few", "CAST(NULL AS DOUBLE) AS none")
    coefficients, summary = run_suite(data, models, lambda d, m: fit_cluster(d, m, "g2"), gate=100)
    states = {r.model: (r.status, r.n) for r in summary.collect()}
    assert states["good"][0] == "PASS" and states["small"] == ("SKIPPED", 30)
    assert states["empty"][0] == "FAILED"
    assert {r.model for r in coefficients.collect()} == {"good"}
