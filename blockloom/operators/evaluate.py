"""Out-of-sample explained variance, measures with typed failures, payload aggregation, correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import BlockTable, clean
from . import solver
from .models import Model
from .moments import Moments, moments

NORMAL = NormalDist()
#: Distinct values of a column up to which their ranks are broadcast.
BROADCAST_RANKS = 2_000_000


def average_rank(col: str, by: tuple[str, ...] = ()) -> Column:
    """Rank from 1 with ties at their average.  Without ``by`` the whole column is ordered in one task."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(col)) + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2.0


def ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns replaced by their average ranks, from distributed counts of distinct values.

    Values are range-partitioned; a running total over partitions' counts, one row each, gives
    every value its rank, so no task orders the whole table.  Up to BROADCAST_RANKS values go to
    the rows; only for more are the rows shuffled.
    """
    own = [c for c in cols if c in df.columns]
    few = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(own)]).first() if own else ()
    few = {c: few[i] <= BROADCAST_RANKS for i, c in enumerate(own)}
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        placed = counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id())
        placed = placed.withColumn("__own", F.sum("__n").over(Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
        sums = placed.groupBy("__p").agg(F.sum("__n").alias("__s"))
        before = sums.withColumn("__b", F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).select("__p", "__b")
        rank = placed.join(F.broadcast(before), "__p").select("__v", (F.col("__b") + F.col("__own") - (F.col("__n") - 1) / 2.0).alias("__r"))
        df = df.join(F.broadcast(rank) if few[c] else rank, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    return df


def correlation_table(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r for each pair of columns, over rows that have both; one aggregate."""
    df = ranked(df, cols) if method == "spearman" else df
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def concordance(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, r, ccc (Lin), slope (of b on a) for pairs of columns, each over the rows that have both; one pass.

    Each task keeps n, means and centred products of each pair; these are merged, so no digits are lost.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    ends = [(cols.index(a), cols.index(b)) for a, b in pairs]
    names = ["i", "n", "mx", "my", "xx", "yy", "xy"]

    def merged(parts: np.ndarray) -> np.ndarray:
        """n, means and centred products of all rows, from those of parts: a row each."""
        n, (mx, my) = parts[:, 0], parts[:, 1:3].T
        total = n.sum()
        if not total:
            return np.zeros(6)
        cx, cy = (n @ mx) / total, (n @ my) / total
        dx, dy = mx - cx, my - cy
        return np.array([total, cx, cy, parts[:, 3].sum() + n @ dx**2, parts[:, 4].sum() + n @ dy**2, parts[:, 5].sum() + n @ (dx * dy)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((len(pairs), 6))
        for batch in batches:
            values = [pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False) for x in batch.columns]
            there = [~np.isnan(x) for x in values]
            for i, (a, b) in enumerate(ends):
                both = there[a] & there[b]
                x, y = values[a][both], values[b][both]
                if len(x):
                    mx, my = x.mean(), y.mean()
                    kept[i] = merged(np.array([kept[i], [len(x), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *[pa.array(v) for v in kept.T]], names)

    def whole(t: pa.Table) -> pa.Table:
        got = merged(np.column_stack([t[c].to_numpy() for c in names[1:]]))
        return pa.table({c: [v] for c, v in zip(names, [t["i"][0].as_py(), *got.tolist()], strict=True)})

    kinds = "i bigint, n double, mx double, my double, xx double, yy double, xy double"
    got = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, kinds).groupBy("i").applyInArrow(whole, kinds)
    less, some = F.col("n") - 1, F.col("n") > 1
    label = lambda k: F.get(F.array(*[F.lit(p[k]) for p in pairs]), F.col("i").cast("int"))
    ccc = F.try_divide(2 * F.col("xy") / less, F.col("xx") / less + F.col("yy") / less + (F.col("mx") - F.col("my")) ** 2)
    return got.select(label(0).alias("a"), label(1).alias("b"), F.col("n").cast("bigint").alias("n"), F.when(some, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))).alias("r"), F.when(some, ccc).alias("ccc"), F.when(some, F.try_divide(F.col("xy"), F.col("xx"))).alias("slope"))


def test_ev(m: Moments, model: Model, deflate: bool = True, loading_source: str = "train", clamp: str = "none", eps_var: float = 1e-12) -> dict:
    """Per component: ev_block, ev_comp, mac (NaN without a valid pair), and cumulative values, from the test rows' moments.

    A block whose scores don't vary gets zero scores: it explains nothing and is in no pair.
    """
    x = solver.Blocks.of(m, model.blocks)
    names, out = list(model.blocks), {"ev_block": [], "ev_comp": [], "mac": []}
    for w, p in zip(model.weights, model.loadings, strict=True):
        w, p = [w[b] for b in names], [p[b] for b in names]
        _, cov = x.score_moments(w)
        r, ok = solver.correlations(cov, eps_var)
        if loading_source == "test_ls":
            p = x.loadings(w)
        took = []
        for b, good in enumerate(ok):
            g = x.cross(b, b)
            took.append(2 * w[b] @ g @ p[b] - (w[b] @ g @ w[b]) * (p[b] @ p[b]) if good else 0.0)
        took = np.array(took)
        if clamp != "none":
            took = np.maximum(took, 0) if clamp == "zero" else np.clip(took, 0, x.total)
        out["ev_block"].append(dict(zip(names, (took / np.maximum(x.total, 1e-12)).tolist(), strict=True)))
        out["ev_comp"].append(float(took.sum() / max(x.total.sum(), 1e-12)))
        out["mac"].append(solver.objective(r, ok, "mac" if model.metric == "variance" else model.metric))
        if deflate:
            x.deflate([v if good else np.zeros(len(v)) for v, good in zip(w, ok, strict=True)], p)
    out["ev_cumulative"] = np.cumsum(out["ev_comp"]).tolist()
    return out


def evaluate(model: Model, table: BlockTable, weights: str = "auto", **options) -> dict:
    """Payload of a model on new rows: test_ev, the rows' number, and the weights that were used."""
    chosen = model.chosen(weights)
    m = moments(table.df, [c for cols in chosen.blocks.values() for c in cols])
    return test_ev(m, chosen, **options) | {"n": int(m.n), "blocks": list(chosen.blocks), "metric": chosen.metric, "weights": chosen.weights}


def running(df: DataFrame, order: str, total: tuple[str, ...] = (), most: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """df with <c>_cumulative for columns of total and <c>_monotone (greatest so far) for those of most, in order within by."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_cumulative": F.sum(c).over(run) for c in total} | {f"{c}_monotone": F.max(c).over(run) for c in most})


def strict_objective(payload: dict, blocks: int) -> float:
    """The mean objective of a payload; raises where a component's is undefined (fewer than two blocks that vary)."""
    mac = np.array(payload["mac"], float)
    if blocks < 2 or not len(mac) or not np.isfinite(mac).all():
        raise ValueError("the objective is undefined: fewer than two blocks vary")
    return float(mac.mean())


def mean_z_score(df: DataFrame, row_id: str, cols: list[str], name: str = "LC") -> DataFrame:
    """row_id and the mean over cols of their z-scores; a column that doesn't vary counts for nothing, a missing value neither."""
    got = df.agg(*[f(clean(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    use = [(c, got[f"m{i}"], got[f"s{i}"]) for i, c in enumerate(cols) if got[f"s{i}"] and got[f"s{i}"] > 1e-12]
    z = [(clean(c) - m) / s for c, m, s in use]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0))
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in z), F.lit(0))
    return df.select(row_id, F.when(n > 0, total / n).alias(name))


def _diagnostic(score: float | None, reason: str = "", message: str = "") -> dict:
    fine = score is not None and math.isfinite(score)
    return {"score": score if fine else None, "defined": fine, "reason": "" if fine else reason or "non_finite_score", "message": message}


def measure(payload: dict | None, name: str) -> dict:
    """{score, defined, reason, message} of mac, ev, block_ev, mac_evwt or mean_ev; Frobenius objectives are divided by the root of the number of pairs."""
    if not payload or not payload.get("ev_comp"):
        return _diagnostic(None, "missing_payload", "there is no payload")
    ev = np.array(payload["ev_comp"], float)
    mac = np.array(payload.get("mac", []), float)
    if payload.get("metric") == "frobenius":
        mac = mac / math.sqrt(math.comb(len(payload["blocks"]), 2))
    if name == "mac":
        return _diagnostic(float(mac.mean()))
    if name in ("ev", "mean_ev"):
        return _diagnostic(float(ev.mean()))
    if name == "block_ev":
        return _diagnostic(float(np.mean([list(r.values()) if isinstance(r, dict) else r for r in payload["ev_block"]])))
    up = np.maximum(ev, 0)
    if up.sum() <= 1e-12:
        return _diagnostic(None, "nonpositive_ev", "no component explains variance")
    return _diagnostic(float((up / up.sum() * mac).sum()))


def fold_table(spark: SparkSession, payloads: list[dict]) -> DataFrame:
    """fold, component, n_test, mac, ev, p_value, block, ev_block; block is null in a component's own row."""
    rows = []
    for f, p in enumerate(payloads, 1):
        for k, (mac, ev) in enumerate(zip(p["mac"], p["ev_comp"], strict=True)):
            pv = (p.get("p_values") or [None] * len(p["mac"]))[k]
            rows.append((f, f"LC_{k + 1:02d}", p["n"], float(mac), float(ev), None if pv is None else float(pv), None, None))
            rows += [(f, f"LC_{k + 1:02d}", p["n"], None, None, None, b, float(x)) for b, x in p["ev_block"][k].items()]
    return spark.createDataFrame(rows, "fold int, component string, n_test int, mac double, ev double, p_value double, block string, ev_block double")


def aggregate_folds(folds: DataFrame, weight_by: str = "sqrt_n") -> DataFrame:
    """component, block (null: all), n_folds, mac, mac_sd, ev: weighted means over folds."""
    w = {"sqrt_n": F.sqrt("n_test"), "n": F.col("n_test").cast("double"), "equal": F.lit(1.0)}[weight_by]
    mean = lambda c: F.sum(F.when(F.col(c).isNotNull(), w * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), w))
    return folds.groupBy("component", "block").agg(F.countDistinct("fold").alias("n_folds"), mean("mac").alias("mac"), F.stddev_samp("mac").alias("mac_sd"), F.coalesce(mean("ev"), mean("ev_block")).alias("ev"))


def stouffer(p: list[float], w: list[float]) -> float:
    """One-sided combination with weights."""
    p = np.clip(p, 1e-15, 1 - 1e-15)
    z = sum(wi * NORMAL.inv_cdf(1 - float(pi)) for pi, wi in zip(p, w, strict=True)) / math.sqrt(sum(x * x for x in w))
    return 1 - NORMAL.cdf(z)


def fisher(p: list[float]) -> float:
    """Tail of a chi-squared with twice as many degrees of freedom as values, which has a closed form."""
    x = -sum(math.log(max(v, 1e-300)) for v in p)
    term = total = 1.0
    for i in range(1, len(p)):
        term *= x / i
        total += term
    return math.exp(-x) * total


def combine_p(folds: DataFrame, method: str = "stouffer", weight_by: str = "sqrt_n", monotone: bool = False) -> dict[str, float]:
    """Combined p-value by component, over folds that have one; monotone: never less than an earlier component's."""
    rows = folds.where("block is null and p_value is not null").select("component", "p_value", "n_test").orderBy("component", "fold").collect()
    out, most = {}, 0.0
    for c in sorted({r["component"] for r in rows}):
        own = [r for r in rows if r["component"] == c]
        w = [{"sqrt_n": math.sqrt(r["n_test"]), "n": r["n_test"], "equal": 1.0}[weight_by] for r in own]
        p = stouffer([r["p_value"] for r in own], w) if method == "stouffer" else fisher([r["p_value"] for r in own])
        most = max(most, p)
        out[c] = most if monotone else p
    return out


def metric_summary(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, sd, median, q05, q95, min, max over finite values, and n, n_total, n_failed."""
    x = F.col(col)
    fine = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    q = lambda p: F.percentile(fine, p)
    return df.groupBy(*by).agg(F.avg(fine).alias("mean"), F.stddev_samp(fine).alias("sd"), q(0.5).alias("median"), q(0.05).alias("q05"), q(0.95).alias("q95"), F.min(fine).alias("min"), F.max(fine).alias("max"), F.count(fine).alias("n"), F.count("*").alias("n_total"), (F.count("*") - F.count(fine)).alias("n_failed"))
