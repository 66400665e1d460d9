import numpy as np
import pandas as pd
import pytest

from panelspark.operators.aggregates import quantile_bin_curve, spearman_matrix
from panelspark.operators.quantiles import (
    average_ranks,
    exact_quantiles,
    global_quantiles,
    group_median,
    histogram,
)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    n = 3000
    frame = pd.DataFrame(
        {
            # one group holds most rows, one value holds a third of them
            "g": rng.choice(["hot", "warm", "rare"], n, p=[0.8, 0.19, 0.01]),
            "v": np.where(rng.random(n) < 0.33, 0.0, rng.normal(0, 50, n).round(2)),
        }
    )
    frame.loc[rng.random(n) < 0.05, "v"] = np.nan
    return frame


def test_group_quantiles_are_exact(spark, values):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(values), ["g"], "v", probabilities).collect()
    assert len(got) == 3 * len(probabilities)
    for row in got:
        own = values.loc[values.g == row.g, "v"]
        assert row.quantile == pytest.approx(own.quantile(row.probability), abs=1e-12)
        assert row.n == own.notna().sum()


def test_null_group_and_all_null_group(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None)]
    got = group_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()
    assert [(r.g, r.m) for r in got] == [(None, 2.0)]


def test_extreme_values(spark):
    data = [-1e300, -5.0, -1e-300, 0.0, 1e-300, 1e-7, 2e-7, 5.0, 1e300]
    frame = spark.createDataFrame([(v,) for v in data], "v double")
    wanted = [i / 8 for i in range(9)]
    assert global_quantiles(frame, "v", wanted) == pytest.approx(data)


def test_average_ranks(spark, values):
    clean = values.dropna()
    got = average_ranks(histogram(spark.createDataFrame(clean), ["g"], "v"), ["g"]).toPandas()
    clean = clean.assign(rank=clean.groupby("g").v.rank())
    merged = clean.merge(got, left_on=["g", "v"], right_on=["g", "_v"])
    assert len(merged) == len(clean)
    assert (merged.rank_x == merged.rank_y).all() if "rank_x" in merged else True


def test_spearman_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(400, 3)).round(1), columns=["a", "b", "c"])
    frame["b"] += frame["a"]
    frame = frame.mask(rng.random(frame.shape) < 0.1)
    got = spearman_matrix(spark.createDataFrame(frame), ["a", "b", "c"]).collect()
    assert len(got) == 9
    for row in got:
        pair = frame[[row.column_x, row.column_y]].dropna() if row.column_x != row.column_y else (
            frame[[row.column_x]].dropna()
        )
        x, y = pair[row.column_x].rank(), pair[row.column_y].rank()
        assert row.spearman == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
        assert row.n == len(pair)


def test_quantile_bins_match_pandas(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"x": rng.gamma(2, 10, 500).round(1), "y": rng.normal(size=500)})
    frame.loc[:150, "x"] = 1.0  # repeated edges
    got = quantile_bin_curve(spark.createDataFrame(frame), "x", {"y_mean": "y"}).toPandas()
    bins = pd.qcut(frame.x, 20, duplicates="drop")
    want = frame.groupby(bins, observed=True).agg(rows=("y", "size"), x=("x", "mean"), y=("y", "mean"))
    got = got.sort_values("bin")
    assert got.rows.tolist() == want.rows.tolist()
    np.testing.assert_allclose(got.x, want.x)
    np.testing.assert_allclose(got.y_mean, want.y)


@pytest.mark.parametrize("scale", ["narrow", "tiny", "heavy"])
def test_buckets_follow_the_data(spark, scale):
    rng = np.random.default_rng(3)
    data = {
        "narrow": rng.normal(50_000, 0.001, 4000), "tiny": rng.random(4000) * 1e-12, "heavy": np.exp(rng.normal(0, 20, 4000)),
    }[scale]
    frame = spark.createDataFrame(pd.DataFrame({"v": data}))
    hist = histogram(frame.repartition(4), [], "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = histogram(frame, [], "v").groupBy("_b").count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and sizes.max() < 0.5 * len(data)
    assert hist.count() == len(np.unique(data))
    found = global_quantiles(frame, "v", [0.1, 0.5, 0.99])
    assert found == pytest.approx(list(np.quantile(data, [0.1, 0.5, 0.99])), rel=1e-12)
