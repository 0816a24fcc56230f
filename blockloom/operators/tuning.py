"""Folds, sequential tuning of sparsity, nested cross-validation and graph builders."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import BlockTable
from . import evaluate, solver
from .inference import StabilitySelection, permutation_test
from .knn import KnnImpute
from .models import MBsPCA, MBsPLS, MBsPLSXY, Model, as_model
from .moments import Moments, moments, moments_by
from .preprocess import BlockScaling, Encode, Fitted, Steps


def with_folds(df: DataFrame, row_id: str, folds: int, seed: int = 0) -> DataFrame:
    """A column fold: a hash of seed and row id, so that a row's fold doesn't depend on the others or on partitions."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)).cast("int"))


def balanced_folds(df: DataFrame, row_id: str, folds: int, seed: int = 0) -> DataFrame:
    """A column fold with equal numbers of rows: places in the order of md5(seed|row_id), for tables that one task can order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(folds)).cast("int"))


@dataclass
class SequentialTuner:
    """Component by component: random whole-number sparsity, scored on folds' cross-products, a combined permutation test, deflation.

    One pass gives every fold's moments; a training fold's are the whole's less the fold's.  With
    steps, each fold's preprocessing is fitted to its training part alone, so nothing of the test
    part leaks into it; that takes a pass for each fold and step.
    Candidates are spread over executors, which hold the folds' matrices only.
    """

    ncomp: int = 2
    budget: int = 40
    folds: int = 3
    metric: str = "mac"
    permutations: int = 0
    alpha: float = 0.05
    seed: int = 0
    pca: bool = False
    max_iter: int = 1000
    tol: float = 1e-4
    steps: list = field(default_factory=list)

    def _split(self, table: BlockTable, f: int) -> tuple[BlockTable, BlockTable, object]:
        """(training part, test part, what is fitted to the first) of a fold, both transformed."""
        df = with_folds(table.df, table.row_id, self.folds, self.seed)
        train, test = table.with_df(df.where(F.col("fold") != f).drop("fold")), table.with_df(df.where(F.col("fold") == f).drop("fold"))
        fitted = Steps(self.steps).fit(train)
        return fitted.transform(train), fitted.transform(test), fitted

    def _prepared(self, table: BlockTable, extra: BlockTable | None) -> tuple[Moments, dict, list[tuple[Moments, Moments]]]:
        """Moments of the whole, blocks, and (training, test) moments of folds, each prepared by the steps as its training part has them."""
        fitted = Steps(self.steps).fit(table)
        ready = fitted.transform(table).resolved()
        cols, folds = ready.columns, []
        add = lambda m, how: m if extra is None else m + moments(how.transform(extra).df, cols)
        for f in range(self.folds):
            train, test, own = self._split(table, f)
            folds.append((add(moments(train.df, cols), own), moments(test.df, cols)))
        return add(moments(ready.df, cols), fitted), dict(ready.blocks), folds

    def fit(self, table: BlockTable, extra: BlockTable | None = None) -> tuple[np.ndarray, list[dict]]:
        """(c: block x component, per component what was chosen); extra: unlabelled rows, which join every training part."""
        spark = table.df.sparkSession
        if self.steps:
            whole, blocks, pairs = self._prepared(table, extra)
        else:
            table = table.resolved()
            cols, blocks = table.columns, dict(table.blocks)
            folds = moments_by(with_folds(table.df, table.row_id, self.folds, self.seed), cols, key="fold")
            more = moments_by(extra.df.withColumn("fold", F.lit(0)), cols, key="fold")[0] if extra is not None else None
            whole = None
            for m in folds.values():
                whole = m if whole is None else whole + m
            if more is not None:
                whole = whole + more
            pairs = [(whole - m, m) for m in folds.values()]
        parts = [(solver.Blocks.of(a, blocks), solver.Blocks.of(b, blocks)) for a, b in pairs if b.n >= 3]
        full, sizes, rng = solver.Blocks.of(whole, blocks), [len(c) for c in blocks.values()], np.random.Generator(np.random.Philox(self.seed))
        solve = solver.one_pca_component if self.pca else solver.one_component
        chosen, log, worst = [], [], 0.0
        for k in range(self.ncomp):
            asked = sorted({tuple(int(rng.integers(1, p + 1)) for p in sizes) for _ in range(self.budget)})
            held, metric, max_iter, tol, seed, pca = spark.sparkContext.broadcast(parts), self.metric, self.max_iter, self.tol, self.seed, self.pca

            def score(batches):
                for pdf in batches:
                    out = []
                    for text in pdf["c"]:
                        c = np.sqrt(np.array([int(x) for x in text.split(",")], float))
                        got = []
                        for train, test in held.value:  # noqa: B023
                            w, _ = solve(train, c, metric=metric, max_iter=max_iter, tol=tol, seed=seed)
                            if pca:
                                p = train.loadings(w)
                                gain = sum(2 * w[b] @ test.cross(b, b) @ p[b] - (w[b] @ test.cross(b, b) @ w[b]) * (p[b] @ p[b]) for b in range(len(w)))
                                got.append(gain / max(sum(np.trace(test.cross(b, b)) for b in range(len(w))), 1e-12))
                            else:
                                got.append(solver.objective(*solver.correlations(test.score_moments(w)[1]), metric))
                        out.append(float(np.mean(got)) if np.all(np.isfinite(got)) else float("-inf"))
                    yield pd.DataFrame({"c": pdf["c"], "score": out})

            frame = spark.createDataFrame([(",".join(map(str, a)),) for a in asked], "c string").repartition(min(len(asked), 4 * spark.sparkContext.defaultParallelism))
            best = frame.mapInPandas(score, "c string, score double").orderBy(F.desc("score"), "c").first()
            c = np.sqrt(np.array([int(x) for x in best["c"].split(",")], float))
            p_value = None
            if self.permutations and not self.pca:
                p_value = self._p_value(table, blocks, c, chosen)
                worst = max(worst, p_value)
                if k and worst > self.alpha:
                    break
            chosen.append(c)
            log.append({"component": k + 1, "c": c.tolist(), "score": best["score"], "p_value": p_value})
            for train, test in parts:
                w, _ = solve(train, c, metric=self.metric, max_iter=self.max_iter, tol=self.tol, seed=self.seed)
                p = train.loadings(w)
                train.deflate(w, p)
                test.deflate(w, p)
            w, _ = solve(full, c, metric=self.metric, max_iter=self.max_iter, tol=self.tol, seed=self.seed)
            full.deflate(w, full.loadings(w))
        return np.column_stack(chosen), log

    def _p_value(self, table: BlockTable, blocks: dict, c: np.ndarray, before: list) -> float:
        """Stouffer's combination of out-of-sample permutation tests over folds."""
        ps, ws = [], []
        for f in range(self.folds):
            train, test, _ = self._split(table, f)
            train = replace(train, blocks=blocks)
            n = test.df.count()
            if n < 3:
                continue
            model = MBsPLS(len(before) + 1, np.column_stack([*before, c]), self.metric, self.max_iter, self.tol, self.seed).fit(train)
            ps.append(permutation_test(model, test, self.permutations, seed=self.seed)[-1]["p_value"])
            ws.append(np.sqrt(n))
        return evaluate.stouffer(ps, ws)


@dataclass
class Pipeline:
    """Steps, a model and perhaps a selection, as one estimator; a learner takes the scores."""

    steps: list
    model: object
    selection: StabilitySelection | None = None
    stability_only: bool = False
    weights: str = "auto"
    learner: object = None

    def fit(self, table: BlockTable) -> FittedPipeline:
        if self.stability_only and self.selection is None:
            raise ValueError("stability_only needs a selection")
        fitted = Steps(self.steps).fit(table)
        ready = fitted.transform(table).resolved()
        model, summary = self.model.fit(ready), None
        if self.selection is not None:
            model, summary = self.selection.fit(ready, model, self.model)
        source = "raw" if self.stability_only and self.weights == "auto" else self.weights
        done = None
        if self.learner is not None:
            scores = model.transform(ready, source)
            done = self.learner(scores, [c for c in scores.columns if c.startswith(model.prefix)], ready.target)
        return FittedPipeline(fitted, model, source, summary, done)


@dataclass
class FittedPipeline:
    steps: Fitted
    model: Model
    source: str
    summary: DataFrame | None = None
    learner: object = None

    def transform(self, table: BlockTable) -> DataFrame:
        scores = self.model.transform(self.steps.transform(table), self.source)
        return self.learner(scores) if self.learner else scores

    def evaluate(self, table: BlockTable, **options) -> dict:
        """Payload of the model on new rows, after the fitted steps."""
        return evaluate.evaluate(self.model, self.steps.transform(table), self.source, **options)


def kmeans(k: int = 1, seed: int = 0):
    """A learner for Pipeline: clusters of the score columns."""

    def fit(scores: DataFrame, cols: list[str], target: str | None):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        put = VectorAssembler(inputCols=cols, outputCol="_scores")
        model = KMeans(k=max(k, 2), seed=seed, featuresCol="_scores", predictionCol="cluster").fit(put.transform(scores)) if k > 1 else None
        return lambda df: model.transform(put.transform(df)).drop("_scores") if model else df.withColumn("cluster", F.lit(0))

    return fit


def featureless():
    """A learner for Pipeline: the most frequent class, or the mean."""

    def fit(scores: DataFrame, cols: list[str], target: str | None):
        if scores.schema[target].dataType.typeName() == "string":
            value = scores.groupBy(target).count().orderBy(F.desc("count"), target).first()[0]
        else:
            value = scores.agg(F.avg(target)).first()[0]
        return lambda df: df.withColumn("response", F.lit(value))

    return fit


def preprocessing(site_steps: list = (), k: int = 5, site_columns: tuple[str, ...] = (), scaling: BlockScaling | None = None) -> list:
    """Steps in the order encode, impute, correct sites, scale."""
    return [Encode(site_columns), KnnImpute(k), *site_steps, scaling or BlockScaling()]


def mbspls_pipeline(site_steps: list = (), k: int = 5, selection: StabilitySelection | None = None, learner=None, weights: str = "auto", **model) -> Pipeline:
    return Pipeline(preprocessing(site_steps, k), MBsPLS(**model), selection, weights=weights, learner=learner)


def mbsplsxy_pipeline(site_steps: list = (), k: int = 5, learner=None, **model) -> Pipeline:
    return Pipeline(preprocessing(site_steps, k), MBsPLSXY(**model), learner=learner)


def mbspca_pipeline(site_steps: list = (), k: int = 5, learner=None, **model) -> Pipeline:
    return Pipeline(preprocessing(site_steps, k), MBsPCA(**model), learner=learner)


REGISTRY = {"mbspls": mbspls_pipeline, "mbsplsxy": mbsplsxy_pipeline, "mbspca": mbspca_pipeline, "blockscale": BlockScaling, "impute_knn": KnnImpute, "preprocessing": preprocessing}


@dataclass
class NestedCV:
    """Outer folds: tune on the training part, refit with what was chosen, evaluate on the test part.

    run(folds=...) takes some of the outer folds, so that a cluster can run them as separate
    jobs; collect() puts their rows together.
    """

    steps: list = field(default_factory=lambda: [BlockScaling()])
    outer: int = 3
    tuner: SequentialTuner = field(default_factory=SequentialTuner)
    measure: str = "mac_evwt"
    permutations: int = 0
    seed: int = 0

    def run(self, table: BlockTable, folds: list[int] | None = None) -> list[dict]:
        df, out = with_folds(table.df, table.row_id, self.outer, self.seed), []
        for f in folds if folds is not None else range(self.outer):
            train, test = table.with_df(df.where(F.col("fold") != f).drop("fold")), table.with_df(df.where(F.col("fold") == f).drop("fold"))
            fitted = Steps(self.steps).fit(train)
            ready = fitted.transform(train).resolved()
            c, log = replace(self.tuner, seed=self.seed, steps=[*self.steps, *self.tuner.steps]).fit(train)
            model = MBsPLS(c.shape[1], c, self.tuner.metric, self.tuner.max_iter, self.tuner.tol, self.seed).fit(ready)
            new = fitted.transform(test)
            payload = evaluate.evaluate(model, new)
            if self.permutations:
                payload["p_values"] = [r["p_value"] for r in permutation_test(model, new, self.permutations, seed=self.seed)]
            score = evaluate.measure(payload, self.measure)
            out.append({"fold": f, "c": c, "inner": log, "payload": payload, **score})
        return out

    @staticmethod
    def collect(spark: SparkSession, rows: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(results by fold, fold table of payloads, summary of scores)."""
        results = spark.createDataFrame([(r["fold"], r["score"], r["defined"], r["reason"], int(r["c"].shape[1])) for r in rows], "fold int, score double, defined boolean, reason string, n_components int")
        return results, evaluate.fold_table(spark, [r["payload"] for r in rows]), evaluate.metric_summary(results, "score")


__all__ = ["FittedPipeline", "NestedCV", "Pipeline", "SequentialTuner", "as_model", "balanced_folds", "featureless", "kmeans", "with_folds"]
