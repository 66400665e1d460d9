"""Wild cluster bootstrap-t from per-cluster cross products.

One pass over the rows gives X_g'X_g and X_g'y per cluster. Everything after
that works on those blocks: the restricted fit, the observed t value and each
repetition. Repetitions are spread over tasks with their weights as rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.regression import (
    Model,
    _as_matrix,
    _cells_to_gram,
    _sum_matrices,
    cell_moments,
    factor_levels,
    generalized_inverse,
    term_names,
    usable_rows,
)
from panelspark.session import materialize

MAX_BLOCK_NUMBERS = 5_000_000
MAX_ENUMERATED_CLUSTERS = 16


def cluster_blocks(df: DataFrame, model: Model, cluster: str):
    """(clusters, terms, blocks): one [X y]'[X y] matrix per cluster."""
    known = df.where(F.col(cluster).isNotNull())
    rows = usable_rows(known, model, [F.col(cluster).cast("string").alias("_g")])
    cells = materialize(cell_moments(rows, model, ["_g"]), "cluster-cells")
    levels = factor_levels(cells, model)
    terms = term_names(model, levels)
    size = len(terms) + 1
    allowed = max(2, MAX_BLOCK_NUMBERS // (size * size))
    found = cells.select("_g").distinct().limit(allowed + 1).count()
    if found > allowed:
        raise ValueError(f"more than {allowed} clusters of {size} terms; use fit_cluster")

    def per_cluster(batch: pd.DataFrame):
        for group, part in batch.groupby("_g"):
            yield (group,), _cells_to_gram(part, model, levels)

    summed = _sum_matrices(cells, per_cluster, ("_g",), "_g string")
    grouped = {group: _as_matrix(own, size) for group, own in summed.groupby("_g")}
    names = sorted(grouped)
    return names, terms, np.stack([grouped[g] for g in names])


def sign_weights(reps: int, clusters: int, seed: int, exact: bool = False) -> np.ndarray:
    """Rademacher signs, one row per repetition.

    ``exact`` lists every sign vector instead of drawing; with few clusters
    there are only 2 ** clusters of them.
    """
    if exact:
        if clusters > MAX_ENUMERATED_CLUSTERS:
            raise ValueError("too many clusters to list every sign vector")
        return np.array(list(itertools.product([-1.0, 1.0], repeat=clusters)))
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(reps, clusters))


def wild_cluster_bootstrap(
    df: DataFrame,
    model: Model,
    cluster: str,
    targets: list[str],
    reps: int = 999,
    seed: int = 20260804,
    exact: bool = False,
) -> list[dict]:
    """One record per target: coefficient, t value, bootstrap p and quantiles.

    Blocks of every cluster go to the driver (bounded by MAX_BLOCK_NUMBERS):
    for listing every sign vector of few clusters, or for repeating draws of
    numpy's generator. ``distributed_bootstrap`` has no bound on clusters.
    """
    spark = df.sparkSession
    groups, terms, blocks = cluster_blocks(df, model, cluster)
    k = len(terms)
    xtx_g, xty_g = blocks[:, :k, :k], blocks[:, :k, k]
    xtx, xty = xtx_g.sum(axis=0), xty_g.sum(axis=0)
    bread, _ = generalized_inverse(xtx)
    beta = bread @ xty
    scores = xty_g - xtx_g @ beta
    weights = sign_weights(reps, len(groups), seed, exact)
    # one row per repetition, so the repetitions spread over the tasks
    draws = spark.createDataFrame(
        pd.DataFrame({"rep": np.arange(len(weights)), "w": list(weights)}),
        "rep long, w array<double>",
    ).repartition(min(len(weights), spark.sparkContext.defaultParallelism))

    records = []
    for target in targets:
        at = terms.index(target)
        direction = bread[at]
        projected = scores @ direction
        se = float(np.sqrt(max(float((projected**2).sum()), 0.0)))
        observed = float(beta[at] / se) if se else 0.0
        kept = [i for i in range(k) if i != at]
        inverse_r, _ = generalized_inverse(xtx[np.ix_(kept, kept)])
        beta_r = np.zeros(k)
        beta_r[kept] = inverse_r @ xty[kept]
        fitted = xtx_g @ beta_r
        residual = xty_g - fitted
        replicate = _replicator(bread, at, fitted, residual, xtx_g)
        t_values = np.array(
            [r["t"] for r in draws.mapInPandas(replicate, "rep long, t double")
             .orderBy("rep").collect()]
        )
        # the all-equal sign vectors reproduce the observed t up to rounding
        hits = float((np.abs(t_values) >= abs(observed) * (1.0 - 1e-9)).sum())
        low, middle, high = np.quantile(t_values, [0.025, 0.5, 0.975])
        records.append(
            {
                "outcome": model.outcome,
                "target": target,
                "coefficient": float(beta[at]),
                "cluster_se_uncorrected": se,
                "observed_t": observed,
                "wild_bootstrap_p_value": (1.0 + hits) / (len(weights) + 1.0),
                "bootstrap_t_2_5pct": float(low),
                "bootstrap_t_50pct": float(middle),
                "bootstrap_t_97_5pct": float(high),
                "observations": int(round(blocks[:, 0, 0].sum())),
                "clusters": len(groups),
                "repetitions": len(weights),
                "seed": seed,
            }
        )
    return records


def _replicator(bread, at, fitted, residual, xtx_g):
    def replicate(batches):
        for batch in batches:
            w = np.stack(batch["w"].to_numpy())
            moved = fitted[None] + w[:, :, None] * residual[None]
            beta = moved.sum(axis=1) @ bread
            score = moved - np.einsum("gij,rj->rgi", xtx_g, beta)
            deviation = np.sqrt(((score @ bread[at]) ** 2).sum(axis=1))
            usable = deviation > 0
            t = np.divide(beta[:, at], deviation, out=np.zeros(len(w)), where=usable)
            yield pd.DataFrame({"rep": batch["rep"], "t": t})

    return replicate


BOOTSTRAP_SCHEMA = (
    "outcome string, target string, coefficient double, cluster_se_uncorrected double, "
    "observed_t double, wild_bootstrap_p_value double, bootstrap_t_2_5pct double, "
    "bootstrap_t_50pct double, bootstrap_t_97_5pct double, observations long, "
    "clusters long, repetitions long, seed long"
)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), element by element."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def counter_signs(seed: int, reps: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rademacher sign of each (repetition, cluster key): a pure function, the same in any task."""
    with np.errstate(over="ignore"):
        start = _mix(np.uint64(seed) + reps.astype(np.uint64)[:, None] * _GOLDEN)
        bits = _mix(start ^ keys.astype(np.uint64)[None, :]) >> np.uint64(63)
    return 1.0 - 2.0 * bits.astype(np.float64)


def distributed_bootstrap(
    df: DataFrame, model: Model, cluster: str, targets: list[str], reps: int = 999, seed: int = 20260804,
    rep_block: int = 1024,
) -> list[dict]:
    """Wild cluster bootstrap-t with drawn signs and any number of clusters.

    With restricted residual blocks res_g = X_g'y - X_g'X_g b_r, h the target's
    row of (X'X)^-1, c_g = h . res_g and v_g = (X'X)^-1 X_g'X_g h, repetition r has
    delta_r = sum_g w_rg res_g, u_r = sum_g w_rg c_g v_g and

        t_r = h . delta_r / sqrt(C - 2 delta_r . u_r + delta_r' Q delta_r),  C = sum c_g^2, Q = sum v_g v_g'.

    The per-cluster vectors stay in Spark; each task multiplies its clusters'
    signs (a pure function of seed, repetition and cluster key) into them, so
    only reps x 2k sums and k x k constants reach the driver.
    """
    known = df.where(F.col(cluster).isNotNull())
    rows = usable_rows(known, model, [F.col(cluster).cast("string").alias("_g")])
    cells = materialize(cell_moments(rows, model, ["_g"]), "cluster-cells")
    levels = factor_levels(cells, model)
    terms = term_names(model, levels)
    k = len(terms)
    gram = _as_matrix(_sum_matrices(cells, lambda b: [((), _cells_to_gram(b, model, levels))], (), ""), k + 1)
    xtx, xty = gram[:k, :k], gram[:k, k]
    bread, _ = generalized_inverse(xtx)
    beta = bread @ xty
    by_cluster = cells.withColumn("_key", F.xxhash64("_g")).repartition("_g")
    groups = cells.select("_g").distinct().count()
    records = []
    for target in targets:
        at = terms.index(target)
        h = bread[at]
        kept = [i for i in range(k) if i != at]
        inverse_r, _ = generalized_inverse(xtx[np.ix_(kept, kept)])
        beta_r = np.zeros(k)
        beta_r[kept] = inverse_r @ xty[kept]

        def per_cluster(batches, beta_r=beta_r, h=h):
            for batch in batches:
                out = []
                for (group, key), part in batch.groupby(["_g", "_key"], sort=False):
                    block = _cells_to_gram(part, model, levels)
                    a, b = block[:k, :k], block[:k, k]
                    residual = b - a @ beta_r
                    out.append((int(key), residual.tolist(), float(h @ residual), (bread @ (a @ h)).tolist(),
                                float(h @ (b - a @ beta))))
                if out:
                    yield pd.DataFrame(out, columns=["key", "res", "c", "v", "obs"])

        scores = materialize(
            by_cluster.mapInPandas(per_cluster, "key long, res array<double>, c double, v array<double>, obs double"),
            "bootstrap-scores",
        )

        def constants(batch):
            v = np.array(batch["v"].tolist()).reshape(len(batch), k)
            c, obs = batch["c"].to_numpy(float), batch["obs"].to_numpy(float)
            padded = np.zeros((k + 1, k + 1))
            padded[:k, :k] = v.T @ v
            padded[k, k] = c @ c
            padded[0, k] = padded[k, 0] = obs @ obs
            yield (), padded

        fixed = _as_matrix(_sum_matrices(scores, constants, (), ""), k + 1)
        q, big_c, observed_sq = fixed[:k, :k], fixed[k, k], fixed[0, k]

        def products(batches):
            total = np.zeros((reps, 2 * k))
            for batch in batches:
                if not len(batch):
                    continue
                keys = batch["key"].to_numpy().astype(np.int64).view(np.uint64)
                stacked = np.hstack([
                    np.array(batch["res"].tolist()).reshape(len(batch), k),
                    batch["c"].to_numpy(float)[:, None] * np.array(batch["v"].tolist()).reshape(len(batch), k),
                ])
                for first in range(0, reps, rep_block):
                    chunk = np.arange(first, min(reps, first + rep_block))
                    total[chunk] += counter_signs(seed, chunk, keys) @ stacked
            rep, pos = np.meshgrid(np.arange(reps), np.arange(2 * k), indexing="ij")
            yield pd.DataFrame({"rep": rep.ravel(), "pos": pos.ravel(), "value": total.ravel()})

        sums = (
            scores.mapInPandas(products, "rep long, pos long, value double")
            .groupBy("rep", "pos").agg(F.sum("value").alias("value")).toPandas()
        )
        table = np.zeros((reps, 2 * k))
        table[sums["rep"].to_numpy(), sums["pos"].to_numpy()] = sums["value"].to_numpy()
        delta, u = table[:, :k], table[:, k:]
        spread = big_c - 2 * np.einsum("ri,ri->r", delta, u) + np.einsum("ri,ij,rj->r", delta, q, delta)
        deviation = np.sqrt(np.maximum(spread, 0.0))
        t_values = np.divide(delta @ h, deviation, out=np.zeros(reps), where=deviation > 0)
        se = float(np.sqrt(max(observed_sq, 0.0)))
        observed = float(beta[at] / se) if se else 0.0
        hits = float((np.abs(t_values) >= abs(observed) * (1.0 - 1e-9)).sum())
        low, middle, high = np.quantile(t_values, [0.025, 0.5, 0.975])
        records.append({
            "outcome": model.outcome, "target": target, "coefficient": float(beta[at]),
            "cluster_se_uncorrected": se, "observed_t": observed,
            "wild_bootstrap_p_value": (1.0 + hits) / (reps + 1.0),
            "bootstrap_t_2_5pct": float(low), "bootstrap_t_50pct": float(middle), "bootstrap_t_97_5pct": float(high),
            "observations": int(round(gram[0, 0])), "clusters": groups, "repetitions": reps, "seed": seed,
        })
    return records
