"""Estimators and models: MB-sPLS, its supervised form and MB-sPCA, fitted from moments."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import BlockTable
from . import solver
from .moments import Moments, moments

TARGET_BLOCK = ".target"


SCORE_NAME = re.compile(r"^(LV|PC)(\d+)_(.*)$", re.S)


def parse_score_name(name: str) -> tuple[str, int, str] | None:
    """(prefix, component, block) of a score column's name, or None of any other's."""
    found = SCORE_NAME.match(name)
    return (found[1], int(found[2]), found[3]) if found else None


@dataclass
class Model:
    """A fitted model.  weights, loadings: component -> block -> array in the order of blocks[block].

    stable holds another set of weights, if a selection has made one; draws its bootstrap table.
    """

    blocks: dict[str, tuple[str, ...]]
    weights: list[dict[str, np.ndarray]]
    loadings: list[dict[str, np.ndarray]]
    objectives: list[float]
    ev_block: list[dict[str, float]]
    ev_comp: list[float]
    p_values: list[float]
    prefix: str = "LV"
    metric: str = "mac"
    c: np.ndarray | None = None
    stable: dict[str, list[dict[str, np.ndarray]]] = field(default_factory=dict)
    stable_loadings: dict[str, list[dict[str, np.ndarray]]] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f"{'LC' if self.prefix == 'LV' else 'PC'}_{k + 1:02d}" for k in range(len(self.weights))]

    def chosen(self, source: str = "auto") -> Model:
        """The model with the asked weights: raw, stable_ci, stable_frequency, or auto (stable if there are any)."""
        if source == "raw" or source == "auto" and not any(np.any(v) for w in self.stable.values() for c in w for v in c.values()):
            return self
        key = next(iter(self.stable)) if source == "auto" else source.removeprefix("stable_")
        if key not in self.stable:
            raise ValueError(f"the model has no {source} weights")
        return replace(self, weights=self.stable[key], loadings=self.stable_loadings.get(key, self.loadings))

    def with_stable(self, key: str, weights: list[dict[str, np.ndarray]], m: Moments) -> Model:
        """A model with a further set of weights and the loadings that they have on the training rows, by their moments: deflation goes on with these."""
        x, names, loadings = solver.Blocks.of(m, self.blocks), list(self.blocks), []
        for w in weights:
            own = [w[b] for b in names]
            p = x.loadings(own)
            loadings.append(dict(zip(names, p, strict=True)))
            x.deflate(own, p)
        return replace(self, stable=self.stable | {key: weights}, stable_loadings=self.stable_loadings | {key: loadings})

    def coefficients(self) -> list[dict[str, np.ndarray]]:
        """Per component and block, what gives the score from the columns as they are: deflation as a rotation."""
        names = list(self.blocks)
        fit = solver.Fit(names, [[w[b] for b in names] for w in self.weights], [[p[b] for b in names] for p in self.loadings])
        return [dict(zip(names, row, strict=True)) for row in solver.rotations(fit)]

    def transform(self, table: BlockTable | DataFrame, weights: str = "auto", append: bool = False) -> DataFrame:
        """Scores LVk_block (PCk_block) as one projection of the columns, on batch and streaming tables alike."""
        df = table.df if isinstance(table, BlockTable) else table
        model, out = self.chosen(weights), {}
        for k, blocks in enumerate(model.coefficients()):
            for b, v in blocks.items():
                if b not in self.hidden:
                    cols, values = self.blocks[b], [float(x) for x in v]
                    if len(cols) <= 64:
                        terms = [F.col(f"`{c}`").cast("double") * x for c, x in zip(cols, values, strict=True) if x] or [F.lit(0.0)]
                        score = terms[0]
                        for t in terms[1:]:
                            score = score + t
                    else:  # a long sum would outgrow what can be compiled
                        pairs = F.zip_with(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]), F.array(*map(F.lit, values)), lambda x, y: x * y)
                        score = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
                    out[f"{self.prefix}{k + 1}_{b}"] = score
        if append:
            return df.withColumns(out)
        used = {c for b in self.blocks for c in self.blocks[b]}
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], *[v.alias(k) for k, v in out.items()])

    def weights_table(self, spark: SparkSession, source: str = "raw") -> DataFrame:
        """component, block, feature, weight, loading."""
        m = self.chosen(source)
        rows = [(n, b, f, float(x), float(y)) for n, w, p in zip(m.names, m.weights, m.loadings, strict=True) for b in w for f, x, y in zip(m.blocks[b], w[b], p[b], strict=True)]
        return spark.createDataFrame(rows, "component string, block string, feature string, weight double, loading double")

    def components_table(self, spark: SparkSession) -> DataFrame:
        """component, objective, ev, p_value, and cumulative ev."""
        ev = np.cumsum(self.ev_comp)
        return spark.createDataFrame([(n, float(o), float(e), None if np.isnan(p) else float(p), float(c)) for n, o, e, p, c in zip(self.names, self.objectives, self.ev_comp, self.p_values, ev, strict=True)], "component string, objective double, ev double, p_value double, ev_cumulative double")

    def blocks_table(self, spark: SparkSession) -> DataFrame:
        """component, block, ev_block."""
        return spark.createDataFrame([(n, b, float(x)) for n, e in zip(self.names, self.ev_block, strict=True) for b, x in e.items()], "component string, block string, ev_block double")

    def flipped(self, signs=-1) -> Model:
        """A new model with signs multiplied in: one number, one a component, or a component x block matrix."""
        s = np.broadcast_to(np.asarray(signs, float).reshape(-1, 1) if np.ndim(signs) == 1 else np.asarray(signs, float), (len(self.weights), len(self.blocks)))
        turn = lambda rows: [{b: s[k, i] * r[b] for i, b in enumerate(self.blocks)} for k, r in enumerate(rows)]
        return replace(self, weights=turn(self.weights), loadings=turn(self.loadings), stable={k: turn(v) for k, v in self.stable.items()}, stable_loadings={k: turn(v) for k, v in self.stable_loadings.items()})

    def to_json(self) -> str:
        plain = lambda rows: [{b: np.asarray(v).tolist() for b, v in r.items()} for r in rows]
        return json.dumps({"blocks": self.blocks, "weights": plain(self.weights), "loadings": plain(self.loadings), "objectives": self.objectives, "ev_block": self.ev_block, "ev_comp": self.ev_comp, "p_values": self.p_values, "prefix": self.prefix, "metric": self.metric, "c": None if self.c is None else self.c.tolist(), "stable": {k: plain(v) for k, v in self.stable.items()}, "stable_loadings": {k: plain(v) for k, v in self.stable_loadings.items()}, "hidden": self.hidden})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        rows = lambda v: [{b: np.array(x) for b, x in r.items()} for r in v]
        return cls({b: tuple(c) for b, c in d["blocks"].items()}, rows(d["weights"]), rows(d["loadings"]), d["objectives"], d["ev_block"], d["ev_comp"], d["p_values"], d["prefix"], d["metric"], None if d["c"] is None else np.array(d["c"]), {k: rows(v) for k, v in d["stable"].items()}, {k: rows(v) for k, v in d.get("stable_loadings", {}).items()}, tuple(d["hidden"]))

    def save(self, spark: SparkSession, path: str) -> None:
        """As one row of Parquet, in any store that Spark writes."""
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(spark.read.parquet(path).first()["model"])


def as_model(fit: solver.Fit, blocks: dict, prefix: str, metric: str, c: np.ndarray, hidden: tuple[str, ...] = ()) -> Model:
    named = lambda rows: [dict(zip(fit.names, r, strict=True)) for r in rows]
    return Model({b: tuple(v) for b, v in blocks.items()}, named(fit.weights), named(fit.loadings), fit.objectives, [{b: float(x) for b, x in zip(fit.names, r, strict=True)} for r in fit.ev_block], fit.ev_comp, fit.p_values, prefix, metric, c, hidden=hidden)


def sparsity(blocks: dict, c, ncomp: int, default) -> np.ndarray:
    """A block x component matrix of bounds: from one (an array, rows in block order, or a dict by block), or one number a block for all components."""
    names = list(blocks)
    if isinstance(c, dict):
        c = np.array([np.broadcast_to(np.asarray(c[b] if b in c else default(len(blocks[b])), float), np.shape(next(iter(c.values()))) or ()) for b in names])
    if c is None:
        c = np.array([default(len(blocks[b])) for b in names])
    c = np.asarray(c, float)
    c = np.repeat(c[:, None], ncomp, axis=1) if c.ndim == 1 else c
    if c.shape[0] != len(names):
        raise ValueError(f"c must have a row for each of {len(names)} blocks")
    return np.clip(c, 1.0, np.sqrt([[len(blocks[b])] for b in names]))


@dataclass
class MBsPLS:
    """Multi-block sparse PLS: fit(table) -> Model; test as solver.components takes it."""

    ncomp: int = 1
    c: object = None
    metric: str = "mac"
    max_iter: int = 600
    tol: float = 1e-4
    seed: int = 0
    permutations: int = 0
    alpha: float = 0.05
    early: float | None = None

    def fit(self, table: BlockTable) -> Model:
        table = table.resolved()
        test = None
        if self.permutations:
            from .inference import train_test

            test = train_test(table, self.permutations, self.metric, self.max_iter, self.tol, self.seed, early=self.early)
        return self.fit_moments(moments(table.df, table.columns), dict(table.blocks), test)

    def fit_moments(self, m: Moments, blocks: dict, test=None) -> Model:
        c = sparsity(blocks, self.c, self.ncomp, lambda p: max(1.0, np.sqrt(p) / 3))
        fit = solver.components(solver.Blocks.of(m, blocks), c, self.metric, self.max_iter, self.tol, self.seed, test, self.alpha)
        return as_model(fit, blocks, "LV", self.metric, c)


@dataclass
class MBsPLSXY(MBsPLS):
    """Supervised: the target becomes a block of its own (one-hot, or one column), repeated y_rep times in the objective."""

    c_target: float = 5.0
    center_y: bool = True
    scale_y: bool = True
    y_rep: int = 1
    emit_y_scores: bool = False
    max_iter: int = 1000
    tol: float = 1e-6

    def fit(self, table: BlockTable) -> Model:
        table = table.resolved()
        if table.target is None:
            raise ValueError("a target is needed")
        if table.task_type == "classif":
            levels = table.levels or tuple(sorted(r[0] for r in table.df.select(F.col(table.target).cast("string")).where(F.col(table.target).isNotNull()).distinct().collect()))
            cols = {f"{TARGET_BLOCK}.{v}": F.when(F.col(table.target).cast("string") == v, 1.0).otherwise(0.0) for v in levels}
        else:
            cols = {f"{TARGET_BLOCK}.y": F.col(table.target).cast("double")}
        df = table.df.withColumns(cols)
        m = moments(df, [*table.columns, *cols])
        y = m.at(cols)
        sd = np.sqrt(m.var[y])
        scale, shift = np.eye(len(m.columns)), np.zeros(len(m.columns))
        if self.scale_y:
            scale[y, y] = 1 / np.where(sd > 1e-12, sd, 1)
        if self.center_y:
            shift[y] = -m.mean[y] * np.diag(scale)[y]
        m = m.mapped(scale, shift, m.columns)
        names = [f"{TARGET_BLOCK}{'' if r == 0 else r + 1}" for r in range(self.y_rep)]
        extra = [f"{c}#{n}" for n in names[1:] for c in cols]
        if extra:  # copies of the target's columns
            copy = np.concatenate([np.eye(len(m.columns))] + [np.eye(len(m.columns))[:, y] for _ in names[1:]], axis=1)
            m = m.mapped(copy, np.zeros(copy.shape[1]), (*m.columns, *extra))
        blocks = dict(table.blocks) | {n: tuple(cols) if i == 0 else tuple(f"{c}#{n}" for c in cols) for i, n in enumerate(names)}
        given = self.c if isinstance(self.c, dict) else None if self.c is None else dict(zip(table.blocks, self.c, strict=True))
        c = {b: (given or {}).get(b, max(1.0, np.sqrt(len(blocks[b])) / 3)) for b in table.blocks} | {n: self.c_target for n in names}
        model = replace(self, c=np.array([c[b] for b in blocks])).fit_moments(m, blocks)
        model.hidden = tuple(names[1:]) if self.emit_y_scores else tuple(names)
        return model


@dataclass
class MBsPCA:
    """Multi-block sparse PCA: scores of each block towards one global component."""

    ncomp: int = 1
    c: object = None
    max_iter: int = 60
    tol: float = 1e-4
    seed: int = 0
    normalize: bool = True
    permutations: int = 0
    alpha: float = 0.05

    def fit(self, table: BlockTable) -> Model:
        table = table.resolved()
        test = None
        if self.permutations:
            from .inference import train_test

            test = train_test(table, self.permutations, "variance", self.max_iter, self.tol, self.seed, pca=True)
        return self.fit_moments(moments(table.df, table.columns), dict(table.blocks), test)

    def fit_moments(self, m: Moments, blocks: dict, test=None) -> Model:
        c = sparsity(blocks, self.c, self.ncomp, np.sqrt)
        solve = lambda *a, **k: solver.one_pca_component(*a, normalize=self.normalize, **k)
        fit = solver.components(solver.Blocks.of(m, blocks), c, "variance", self.max_iter, self.tol, self.seed, test, self.alpha, solve)
        return as_model(fit, blocks, "PC", "variance", c)
