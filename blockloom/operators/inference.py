"""Permutation and bootstrap tests, and stability selection by bootstrap."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import BlockTable
from . import solver
from .models import MBsPLS, Model
from .moments import moment_cells, moments, of_cells

#: Cells of a table that may be copied to executors for tests that pair rows anew in each replicate.
LOCAL_CELLS = 50_000_000


def local(table: BlockTable) -> list[np.ndarray]:
    """Block matrices on the driver, if they are small enough; raises otherwise."""
    n = table.df.count()
    if n * len(table.columns) > LOCAL_CELLS:
        raise ValueError(f"{n} x {len(table.columns)} cells are too many to permute; at most {LOCAL_CELLS}")
    x = table.df.orderBy(table.row_id).select(*[F.col(f"`{c}`").cast("double") for c in table.columns]).toArrow()
    cols = {c: x.column(i).to_numpy() for i, c in enumerate(table.columns)}
    return [np.column_stack([cols[c] for c in own]) for own in table.blocks.values()]


def _replicates(spark: SparkSession, n: int, work, seed: int, first: int = 0) -> np.ndarray:
    """work(rng) for replicates first to first + n - 1, on executors; replicate r has its own random numbers."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "value": [float(work(np.random.Generator(np.random.Philox(key=[seed, int(r)])))) for r in pdf["id"]]})

    parts = min(n, max(1, spark.sparkContext.defaultParallelism * 2))
    return spark.range(first, first + n, 1, parts).mapInPandas(run, "id bigint, value double").orderBy("id").toPandas()["value"].to_numpy()


def _p_value(spark: SparkSession, n: int, work, seed: int, value: float, early: float | None = None, least: int = 100, step: int = 50) -> float:
    """The share of replicates that reach value, by (k + 1) / (n + 1).

    With early, replicates come in batches, and no more are drawn once ``least`` have shown that
    the p-value of all n would be over early.
    """
    reached = done = 0
    while done < n:
        size = min(n - done, n if early is None else least if not done else step)
        reached += int((_replicates(spark, size, work, seed, done) >= value - 1e-12).sum())
        done += size
        if early is not None and (reached + 1) / (n + 1) > early:
            break
    return (reached + 1) / (done + 1)


def _pair_objective(t: np.ndarray, metric: str) -> float:
    return solver.objective(*solver.correlations(np.cov(t, rowvar=False)), metric)


def train_test(table: BlockTable, n_perm: int, metric: str, max_iter: int, tol: float, seed: int, pca: bool = False, early: float | None = None):
    """For solver.components: the p-value of a component by refits on blocks whose rows are permuted.

    Within a block, cross-products don't change when its rows move, so only those between blocks
    are computed anew, from matrices that executors hold.
    """
    x, spark = local(table), table.df.sparkSession
    held = spark.sparkContext.broadcast(x)

    def test(now: solver.Blocks, w, c, value) -> float:
        base = now.copy()
        solve = solver.one_pca_component if pca else solver.one_component
        # Deflation is linear: what stands in the blocks now is the columns times a matrix.
        maps = [now.a[np.ix_(i, i)] for i in now.index]

        def work(rng) -> float:
            own = [(m[rng.permutation(len(m))] @ a) for m, a in zip(held.value, maps, strict=True)]
            y = base.copy()
            for a, b in combinations(range(len(own)), 2):
                g = own[a].T @ own[b]
                y.g[np.ix_(y.index[a], y.index[b])], y.g[np.ix_(y.index[b], y.index[a])] = g, g.T
            return solve(y, c, metric=metric, max_iter=max_iter, tol=tol, seed=int(rng.integers(1 << 31)))[1]

        return _p_value(spark, n_perm, work, seed, value, early)

    return test


def scores_of(model: Model, table: BlockTable, component: int = 0) -> np.ndarray:
    """One component's block scores as a matrix; bounded by LOCAL_CELLS."""
    n = table.df.count()
    if n * len(model.blocks) > LOCAL_CELLS:
        raise ValueError("too many scores for a resampling test on one executor each")
    cols = [f"`{model.prefix}{component + 1}_{b}`" for b in model.blocks if b not in model.hidden]
    return np.column_stack([c.to_numpy() for c in model.transform(table).orderBy(table.row_id).select(*cols).toArrow().columns])


def permutation_test(model: Model, table: BlockTable, n_perm: int = 1000, permute_all: bool = True, seed: int = 0, early: float | None = None) -> list[dict]:
    """Per component {stat, p_value}: fixed weights; since permuting rows commutes with the projection, only scores are permuted."""
    spark, out = table.df.sparkSession, []
    for k in range(len(model.weights)):
        t = scores_of(model, table, k)
        stat, held = _pair_objective(t, model.metric), spark.sparkContext.broadcast(t)

        def work(rng) -> float:
            t = held.value  # noqa: B023
            moved = [t[:, b] if b == 0 and not permute_all else t[rng.permutation(len(t)), b] for b in range(t.shape[1])]
            return _pair_objective(np.column_stack(moved), model.metric)

        out.append({"stat": stat, "p_value": _p_value(spark, n_perm, work, seed + k, stat, early)})
    return out


def bootstrap_test(model: Model, table: BlockTable, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> list[dict]:
    """Per component {stat, mean, sd, low, high, p_value}: rows resampled with replacement; normal interval.

    The p-value counts replicates at or below zero, which absolute correlations never are; it is
    kept for what it is, and the interval is what tells.
    """
    from statistics import NormalDist

    spark, z, out = table.df.sparkSession, NormalDist().inv_cdf(1 - alpha / 2), []
    for k in range(len(model.weights)):
        t = scores_of(model, table, k)
        held = spark.sparkContext.broadcast(t)
        values = _replicates(spark, n_boot, lambda rng: _pair_objective(held.value[rng.integers(0, len(held.value), len(held.value))], model.metric), seed + k)  # noqa: B023
        values = values[np.isfinite(values)]
        mean, sd = float(values.mean()), float(values.std(ddof=1))
        out.append({"stat": _pair_objective(t, model.metric), "mean": mean, "sd": sd, "low": mean - z * sd, "high": mean + z * sd, "p_value": float(((values <= 0).sum() + 1) / (len(values) + 1))})
    return out


def assignment(gain: np.ndarray) -> list[int]:
    """A column for each row, all different, so that the sum of gains is largest: by shortest augmenting paths, for any size.

    There must be at least as many columns as rows.
    """
    k, q = gain.shape
    cost = gain.max(initial=0.0) - gain
    row_price, price, of = np.zeros(k), np.zeros(q), np.full(q, -1)
    for i in range(k):
        # Cheapest way from row i to each column over columns that are taken, then to a free one.
        best, via, done, now, spent, last = np.full(q, np.inf), np.full(q, -1), np.zeros(q, bool), i, 0.0, -1
        while True:
            way = spent + cost[now] - row_price[now] - price
            shorter = ~done & (way < best)
            best[shorter], via[shorter] = way[shorter], last
            last = int(np.argmin(np.where(done, np.inf, best)))
            spent = best[last]
            if of[last] < 0:
                break
            done[last], now = True, of[last]
        row_price[i] += spent
        row_price[of[done]] += spent - best[done]
        price[done] -= spent - best[done]
        while last >= 0:
            of[last], last = (of[via[last]] if via[last] >= 0 else i), int(via[last])
    out = [0] * k
    for j, i in enumerate(of):
        if i >= 0:
            out[i] = j
    return out


@dataclass
class StabilitySelection:
    """Refits on bootstrap replicates, aligns components and signs, and keeps features that prove stable.

    Replicates are Poisson(1) row weights by a hash of the row id, so all of them come from one
    pass of weighted cross-products, whatever the number of rows.
    """

    replicates: int = 100
    alpha: float = 0.05
    align: str = "block_sign"
    method: str = "ci"
    frequency_threshold: float = 0.6
    magnitude_threshold: float = 1e-3
    source: str = "training"
    min_score_cor: float = 0.1
    seed: int = 20250921

    def draws(self, table: BlockTable, model: Model, estimator: MBsPLS) -> DataFrame:
        """replicate, component, block, feature, weight, accepted: one row a weight of each refit.

        A replicate's cross-products are one group; they are as large as the columns make them,
        however many rows there are, and executors refit them.
        """
        cols, names = tuple(c for own in model.blocks.values() for c in own), list(model.blocks)
        whole = moments(table.df, cols)
        centred = whole.g - np.outer(whole.s, whole.s) / whole.n
        at, k = {b: whole.at(model.blocks[b]) for b in names}, len(model.weights)
        plain = replace(estimator, ncomp=k, c=None if model.c is None else model.c[:, :k], permutations=0)
        align, least = self.align, self.min_score_cor

        def refit(key, cells: pd.DataFrame) -> pd.DataFrame:
            """Weights of one replicate's fit, each component beside the model's that it is most like."""
            fit = plain.fit_moments(of_cells(cols, *(cells[c].to_numpy() for c in ("i", "j", "x"))), model.blocks)
            cor = np.zeros((k, len(fit.weights), len(names)))
            for i, j in np.ndindex(*cor.shape[:2]):
                for b, name in enumerate(names):
                    g, u, v = centred[np.ix_(at[name], at[name])], model.weights[i][name], fit.weights[j][name]
                    size = np.sqrt(max(u @ g @ u, 0) * max(v @ g @ v, 0))
                    cor[i, j, b] = u @ g @ v / size if size > 1e-12 else 0.0
            like = np.abs(cor).mean(axis=2)
            # Of fewer refitted components than the model has, each finds its own; the rest have none.
            match = enumerate(assignment(like)) if like.shape[1] >= k else [(i, j) for j, i in enumerate(assignment(like.T))]
            rows = []
            for i, j in match:
                strongest = np.sign(cor[i, j, np.argmax(np.abs(cor[i, j]))]) or 1.0
                for name in names:
                    s = strongest if align == "score_correlation" else np.sign(model.weights[i][name] @ fit.weights[j][name]) or 1.0
                    rows += [(int(key[0]), model.names[i], name, f, float(s * x), bool(like[i, j] >= least)) for f, x in zip(model.blocks[name], fit.weights[j][name], strict=True)]
            return pd.DataFrame(rows, columns=["replicate", "component", "block", "feature", "weight", "accepted"])

        cells = moment_cells(table.df, cols, replicates=self.replicates, row_id=table.row_id, seed=self.seed)
        return cells.groupBy("k").applyInPandas(refit, "replicate int, component string, block string, feature string, weight double, accepted boolean")

    def fit(self, table: BlockTable, model: Model, estimator: MBsPLS) -> tuple[Model, DataFrame]:
        """The model with stable weights beside its own, and the summary of draws."""
        spark = table.df.sparkSession
        # Cached, since the summary reads the refits twice.
        summary = summarize_draws(self.draws(table, model, estimator).where("accepted").cache(), model.weights_table(spark).select("component", "block", "feature", F.col("weight").alias("reference")), self.alpha)
        kept = {(r["component"], r["block"], r["feature"]): r for r in select_stable(summary, self.method, self.frequency_threshold, self.magnitude_threshold).collect()}
        weights = []
        for n, w in zip(model.names, model.weights, strict=True):
            one = {}
            for b, v in w.items():
                chosen = [kept.get((n, b, f)) for f in model.blocks[b]]
                one[b] = np.array([0.0 if c is None else (c["mean"] if self.source == "bootstrap_mean" else x) for c, x in zip(chosen, v, strict=True)])
            weights.append(one)
        cols = [c for own in model.blocks.values() for c in own]
        return model.with_stable("ci" if self.method == "ci" else "frequency", weights, moments(table.df, cols)), summary


def summarize_draws(draws: DataFrame, grid: DataFrame, alpha: float = 0.05) -> DataFrame:
    """component, block, feature, mean, sd, low, high, n_selected, n_eff, freq for every row of the grid."""
    key = ["component", "block", "feature"]
    stats = draws.groupBy(*key).agg(F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("sd"), F.percentile("weight", alpha / 2).alias("low"), F.percentile("weight", 1 - alpha / 2).alias("high"), F.sum(F.when(F.abs("weight") > 1e-12, 1).otherwise(0)).alias("n_selected"))
    n_eff = draws.groupBy("component").agg(F.countDistinct("replicate").alias("n_eff"))
    out = grid.select(*key).join(stats, key, "left").join(n_eff, "component", "left")
    n = F.coalesce("n_selected", F.lit(0))
    return out.select(*key, "mean", "sd", "low", "high", n.alias("n_selected"), F.coalesce("n_eff", F.lit(0)).alias("n_eff"), F.when(F.col("n_eff") > 0, n / F.col("n_eff")).alias("freq"))


def overlaps_zero(low: str = "low", high: str = "high") -> Column:
    """Whether an interval holds zero, its bounds included."""
    return (F.col(low) <= 0) & (F.col(high) >= 0)


def latent_correlation(weights: DataFrame, method: str = "pearson", metric: str = "mac", least: int = 3, eps: float = 1e-12) -> float:
    """Agreement of blocks' weights: over components and pairs of blocks, the mean absolute correlation (or, frobenius, the root of summed squares) of absolute weights.

    weights has component, block, feature and weight; features are matched by their place in the
    order of names.  Blocks with fewer than ``least`` features or without variance are left out;
    blocks of different size can't be matched and raise.  spearman ranks equal weights by place.
    """
    by = Window.partitionBy("component", "block")
    own = weights.select("component", "block", F.abs("weight").alias("w"), F.row_number().over(by.orderBy("feature")).alias("place"))
    own = own.withColumn("n", F.count("*").over(by)).withColumn("v", F.var_samp("w").over(by)).where((F.col("n") >= least) & (F.col("v") > eps))
    if method == "spearman":
        own = own.withColumn("w", F.row_number().over(by.orderBy("w", "place")).cast("double"))
    other = own.select("component", "place", F.col("block").alias("other"), F.col("w").alias("u"), F.col("n").alias("m"))
    pairs = own.join(other, ["component", "place"]).where("block < other").groupBy("component", "block", "other").agg(F.corr("w", "u").alias("r"), F.max(F.col("n") != F.col("m")).alias("unequal"))
    got = pairs.agg(F.count("r").alias("k"), F.sum(F.abs("r")).alias("a"), F.sum(F.col("r") ** 2).alias("s"), F.max("unequal").alias("unequal")).first()
    if got["unequal"]:
        raise ValueError("blocks of different sizes can't be matched feature by feature")
    if not got["k"]:
        raise ValueError("no pair of blocks can be compared")
    return float(got["a"] / got["k"] if metric == "mac" else got["s"] ** 0.5)


def select_stable(summary: DataFrame, method: str = "ci", frequency: float = 0.6, magnitude: float = 1e-3) -> DataFrame:
    """Features whose interval doesn't cross zero (a bound at zero is fine) and whose mean is large enough, or that are often selected."""
    if method == "frequency":
        return summary.where(F.col("freq") >= frequency)
    return summary.where(((F.col("low") >= 0) | (F.col("high") <= 0)) & (F.abs("mean") > magnitude))


def top_features(df: DataFrame, n: int, value: str = "mean") -> DataFrame:
    """The n largest by absolute value in each component and block, ties by name."""
    by = Window.partitionBy("component", "block").orderBy(F.desc(F.abs(F.col(value))), "feature")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
