"""Train/predict transformers: fit(table) -> fitted, fitted.transform(table) -> table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import BlockTable, clean, present
from . import solver
from .moments import moments
from .quantiles import grouped_quantiles


@dataclass
class Fitted:
    """A transformer after training: apply turns a table into a table."""

    apply: Callable[[BlockTable], BlockTable]
    state: dict = field(default_factory=dict)

    def transform(self, table: BlockTable) -> BlockTable:
        return self.apply(table)


def _number(x: float | None) -> float:
    return float("nan") if x is None else float(x)


@dataclass
class BlockScaling:
    """none, unit_ssq (each block's sum of squares is one), feature_sd or feature_zscore; then divided by the root of the block's size."""

    method: str = "unit_ssq"
    divide_by_sqrt_p: bool = True
    eps: float = 1e-8

    def fit(self, table: BlockTable) -> Fitted:
        blocks = dict(table.blocks) or {".all": [f.name for f in table.df.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]}
        cols = [c for own in blocks.values() for c in own]
        got = table.df.agg(*[f(clean(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("q", lambda x: F.sum(x * x)))]).first() if cols else {}
        at, scale, centre = {c: i for i, c in enumerate(cols)}, {}, {}
        good = lambda x: x if np.isfinite(x) and x >= self.eps else 1.0
        for own in blocks.values():
            whole = good(np.sqrt(np.nansum([_number(got[f"q{at[c]}"]) for c in own])))
            root = np.sqrt(len(own)) if self.divide_by_sqrt_p else 1.0
            for c in own:
                sd = good(_number(got[f"s{at[c]}"]))
                scale[c] = {"none": 1.0, "unit_ssq": whole}.get(self.method, sd) * root
                centre[c] = _number(got[f"m{at[c]}"]) if self.method == "feature_zscore" else 0.0

        def apply(t: BlockTable) -> BlockTable:
            return t.with_df(t.df.withColumns({c: (F.col(f"`{c}`").cast("double") - centre[c]) / scale[c] for c in cols}))

        return Fitted(apply, {"scale": scale, "centre": centre})


@dataclass
class Encode:
    """Treatment contrasts: of each string column a dummy base.level for all fitted levels but the first; excluded columns stay."""

    exclude: tuple[str, ...] = ()

    def fit(self, table: BlockTable) -> Fitted:
        cols = [c for c in table.columns if table.df.schema[c].dataType.typeName() == "string" and c not in self.exclude]
        levels = {c: sorted(x for x in (r[0] for r in table.df.select(c).distinct().collect()) if x is not None) for c in cols}

        def apply(t: BlockTable) -> BlockTable:
            new = {f"{c}.{v}": F.when(F.col(f"`{c}`") == v, 1.0).when(F.col(f"`{c}`").isNotNull(), 0.0) for c in cols for v in levels[c][1:]}
            blocks = {b: tuple(x for c in own for x in ([f"{c}.{v}" for v in levels[c][1:]] if c in levels else [c])) for b, own in t.blocks.items()}
            return replace(t, df=t.df.withColumns(new).drop(*cols), blocks={b: c for b, c in blocks.items() if c})

        return Fitted(apply, {"levels": levels})


@dataclass
class LabelFilter:
    """Keeps rows whose target is among labels (or isn't); the level set keeps two entries at least.  At prediction without the target nothing happens."""

    labels: tuple[str, ...]
    target: str | None = None
    invert: bool = False
    drop_unused_levels: bool = True
    drop_stratum: bool = False

    def fit(self, table: BlockTable) -> Fitted:
        name = self.target or table.target

        def apply(t: BlockTable, fitting: bool = False) -> BlockTable:
            if name not in t.df.columns:
                if fitting:
                    raise ValueError(f"no column {name}")
                return t
            inside = F.col(name).cast("string").isin(*self.labels)
            kept = t.filter(~inside if self.invert else inside)
            if fitting:
                if kept.df.isEmpty():
                    raise ValueError("the filter leaves no rows")
                return kept
            every = t.levels or tuple(sorted({r[0] for r in t.df.select(F.col(name).cast("string")).distinct().collect() if r[0] is not None}))
            left = tuple(v for v in every if (v in self.labels) != self.invert) if self.drop_unused_levels else every
            left += tuple(v for v in every if v not in left)[: max(0, 2 - len(left))]
            roles = {k: tuple(c for c in own if not (self.drop_stratum and k == "stratum" and c == name)) for k, own in t.roles.items()}
            return replace(kept, levels=left, roles=roles)

        apply(table, True)
        return Fitted(apply)


@dataclass
class Suffix:
    """Renames block columns with a suffix; the map of the training replays at prediction, all of it or none."""

    suffix: str = "_sfx"
    skip_already_suffixed: bool = True
    error_on_collision: bool = True

    def fit(self, table: BlockTable) -> Fitted:
        names = {c: c + self.suffix for c in table.columns if not (self.skip_already_suffixed and c.endswith(self.suffix))}
        taken = [n for n in names.values() if n in table.df.columns and n not in names]
        if taken and self.error_on_collision:
            raise ValueError(f"columns exist already: {', '.join(taken)}")
        return Fitted(lambda t: t.renamed(names) if all(c in t.df.columns for c in names) else t, {"names": names})


def _place(value: Column, levels: list[str]) -> Column:
    """A value's place among levels, from 0; null if it isn't among them."""
    out = F.when(F.lit(False), -1)
    for i, v in enumerate(levels):
        out = out.when(value == v, i)
    return out


def _levels(df: DataFrame, col: str) -> list[str]:
    return sorted(str(r[0]) for r in df.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().collect())


@dataclass
class PartialCorrection:
    """Takes out what a design of site and covariates explains, by least squares; the mean stays unless zero_center.

    The fit needs one pass of cross-products of design and columns.  unknown_site: none leaves
    rows of unseen sites as they are, baseline treats them as the first level.  subgroup, a column
    and some of its values, fits to these rows alone (controls, say) and corrects all.
    """

    site: str
    covariates: tuple[str, ...] = ()
    ridge: float = 0.0
    zero_center: bool = False
    revert: bool = False
    unknown_site: str = "none"
    subgroup: tuple[str, tuple] | None = None

    def fit(self, table: BlockTable) -> Fitted:
        if self.subgroup is not None:
            table = table.filter(F.col(self.subgroup[0]).isin(*self.subgroup[1]))
            if table.df.isEmpty():
                raise ValueError(f"no row has {self.subgroup[0]} among {self.subgroup[1]}")
        cols, sites = table.columns, _levels(table.df, self.site)
        kinds = {c: table.df.schema[c].dataType.typeName() for c in self.covariates}
        levels = {c: _levels(table.df, c) for c in self.covariates if kinds[c] in ("string", "boolean")}

        def design(site: Column) -> dict[str, Column]:
            out = {"__one": F.lit(1.0)} | {f"__site_{v}": F.when(site == v, 1.0).otherwise(0.0) for v in sites[1:]}
            for c in self.covariates:
                out |= {f"__{c}_{v}": F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in levels[c][1:]} if c in levels else {f"__{c}": F.col(c).cast("double")}
            return out

        names = list(design(F.col(self.site)))
        m = moments(table.df.withColumns(design(F.col(self.site).cast("string"))), [*names, *cols])
        beta = solver.least_squares(m, names, cols, self.ridge, ("__one",))
        mean = m.mean[m.at(cols)] * (0.0 if self.zero_center else 1.0)

        at, one = {n: i for i, n in enumerate(names)}, beta[0]
        by_site = np.array([one, *[one + beta[at[f"__site_{v}"]] for v in sites[1:]]])
        by_level = {c: np.array([np.zeros(len(cols)), *[beta[at[f"__{c}_{v}"]] for v in levels[c][1:]]]) for c in levels}

        def apply(t: BlockTable) -> BlockTable:
            place = _place(F.col(self.site).cast("string"), sites)
            places = {"__at": F.coalesce(place, F.lit(0)) if self.unknown_site == "baseline" else place}
            places |= {f"__at_{c}": F.coalesce(_place(F.col(c).cast("string"), levels[c]), F.lit(0)) for c in levels}
            numbers = {f"__at_{c}": F.col(c).cast("double") for c in self.covariates if c not in levels}
            out = {}
            for j, c in enumerate(cols):
                fit = F.get(F.array(*[F.lit(float(v)) for v in by_site[:, j]]), F.col("__at"))
                for n, own in by_level.items():
                    fit = fit + F.get(F.array(*[F.lit(float(v)) for v in own[:, j]]), F.col(f"__at_{n}"))
                for n in [n for n in self.covariates if n not in levels]:
                    fit = fit + F.col(f"__at_{n}") * float(beta[at[f"__{n}"], j])
                x = F.col(f"`{c}`").cast("double")
                new = x + fit - float(mean[j]) if self.revert else x - fit + float(mean[j])
                out[c] = F.when(F.col("__at").isNotNull(), new).otherwise(x)
            return t.with_df(t.df.withColumns(places | numbers).withColumns(out).drop(*places, *numbers))

        return Fitted(apply, {"beta": beta, "design": names})


@dataclass
class ComBat:
    """Location and scale of batches with empirical Bayes shrinkage, as published by Johnson, Li and Rabinovic (2007).

    Training moments per batch and column come from one grouped aggregate; unseen batches stay as
    they are, or count as the first (baseline).
    """

    site: str
    eb: bool = True
    mean_only: bool = False
    ref_batch: str | None = None
    unknown: str = "noop"

    def fit(self, table: BlockTable) -> Fitted:
        cols, batches = table.columns, _levels(table.df, self.site)
        got = {str(r["b"]): r for r in table.df.where(present(self.site) if self.site in cols else F.col(self.site).isNotNull()).groupBy(F.col(self.site).cast("string").alias("b")).agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("v", F.var_samp))]).collect()}
        n = np.array([got[b]["n"] for b in batches], float)
        mu = np.array([[_number(got[b][f"m{i}"]) for i in range(len(cols))] for b in batches])
        var = np.nan_to_num(np.array([[_number(got[b][f"v{i}"]) for i in range(len(cols))] for b in batches]))
        if self.ref_batch is not None:
            r = batches.index(self.ref_batch)
            alpha, pooled = mu[r], var[r] * (n[r] - 1) / n[r]
        else:
            alpha, pooled = n @ mu / n.sum(), ((n - 1)[:, None] * var).sum(axis=0) / n.sum()
        sd = np.sqrt(np.where(pooled > 1e-12, pooled, 1.0))
        gamma, delta = (mu - alpha) / sd, np.maximum(var / sd**2, 1e-12)
        if self.mean_only:
            delta = np.ones_like(delta)
        g_star, d_star = gamma.copy(), delta.copy()
        if self.eb and len(cols) > 1:
            for i in range(len(batches)):
                g, t2 = gamma[i].mean(), max(gamma[i].var(ddof=1), 1e-12)
                if self.mean_only:
                    g_star[i] = (t2 * n[i] * gamma[i] + g) / (t2 * n[i] + 1)
                    continue
                dm, dv = delta[i].mean(), max(delta[i].var(ddof=1), 1e-12)
                a, b = (2 * dv + dm**2) / dv, (dm * dv + dm**3) / dv
                gs, ds = gamma[i].copy(), delta[i].copy()
                for _ in range(500):
                    new_g = (t2 * n[i] * gamma[i] + ds * g) / (t2 * n[i] + ds)
                    # The sum of squares about new_g, from the batch's mean and variance.
                    ss = (n[i] - 1) * delta[i] + n[i] * (gamma[i] - new_g) ** 2
                    new_d = (0.5 * ss + b) / (n[i] / 2 + a - 1)
                    moved = max(np.abs(new_g - gs).max() / max(np.abs(gs).max(), 1e-12), np.abs(new_d - ds).max() / max(np.abs(ds).max(), 1e-12))
                    gs, ds = new_g, new_d
                    if moved < 1e-4:
                        break
                g_star[i], d_star[i] = gs, ds
        if self.ref_batch is not None:
            g_star[r], d_star[r] = 0.0, 1.0

        def apply(t: BlockTable) -> BlockTable:
            site = F.col(self.site).cast("string")
            site = F.when(site.isin(*batches), site).otherwise(batches[0]) if self.unknown == "baseline" else site
            out = {}
            for j, c in enumerate(cols):
                x, new = F.col(f"`{c}`").cast("double"), None
                for i, b in enumerate(batches):
                    value = (((x - float(alpha[j])) / float(sd[j])) - float(g_star[i, j])) / float(np.sqrt(d_star[i, j])) * float(sd[j]) + float(alpha[j])
                    new = F.when(site == b, value) if new is None else new.when(site == b, value)
                out[c] = new.otherwise(x)
            return t.with_df(t.df.withColumns(out))

        return Fitted(apply, {"gamma": g_star, "delta": d_star})


@dataclass
class QuantileRepair:
    """Moves each column, by ``amount``, to the median over protected groups of the groups' quantiles (Feldman et al. 2015).

    Quantiles are exact, from two passes; rows are moved by binary search among them.
    """

    protected: str
    amount: float = 0.5
    grid: int = 101

    def fit(self, table: BlockTable) -> Fitted:
        groups, cols = _levels(table.df, self.protected), table.columns
        if len(groups) < 2:
            raise ValueError("the protected column needs two levels at least")
        quantiles = grouped_quantiles(table.df, self.protected, cols, [i / (self.grid - 1) for i in range(self.grid)])
        empty = [f"{c} where {self.protected} is {g}" for g in groups for c in cols if (g, c) not in quantiles]
        if empty:
            raise ValueError(f"no values of {', '.join(empty[:10])}")
        own = np.array([[quantiles[g, c] for c in cols] for g in groups], float).reshape(len(groups), len(cols), self.grid)
        middle, amount = np.median(own, axis=0), self.amount

        @F.pandas_udf(", ".join(f"c{j} double" for j in range(len(cols))))
        def moved(at: pd.Series, *xs: pd.Series) -> pd.DataFrame:
            out, at = {}, at.to_numpy()
            for j, x in enumerate(xs):
                x = x.to_numpy(dtype=float, na_value=np.nan)
                new = x.copy()
                for i in range(len(own)):
                    mine = at == i
                    v, q, m = x[mine], own[i, j], middle[j]
                    k = np.clip(np.searchsorted(q, v, "right") - 1, 0, len(q) - 2)
                    low, high = q[k], q[k + 1]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        part = np.where(high > low, np.fmin((v - low) / (high - low), 1.0), 0.0)
                    new[mine] = (1 - amount) * v + amount * (m[k] + np.maximum(part, 0.0) * (m[k + 1] - m[k]))
                out[f"c{j}"] = new
            return pd.DataFrame(out)

        def apply(t: BlockTable) -> BlockTable:
            got = moved(F.coalesce(_place(F.col(self.protected).cast("string"), groups), F.lit(-1)), *[F.col(f"`{c}`").cast("double") for c in cols])
            out = {}
            for j, c in enumerate(cols):
                x = F.col(f"`{c}`").cast("double")
                out[c] = F.when(x.isNull() | F.isnan(x), x).otherwise(F.col(f"__moved.c{j}"))
            return t.with_df(t.df.withColumn("__moved", got).withColumns(out).drop("__moved"))

        return Fitted(apply, {"quantiles": quantiles})


@dataclass
class Steps:
    """Transformers one after another: each is fitted on what those before it make of the training table."""

    steps: list

    def fit(self, table: BlockTable) -> Fitted:
        done = []
        for s in self.steps:
            done.append(s.fit(table))
            table = done[-1].transform(table)

        def apply(t: BlockTable) -> BlockTable:
            for f in done:
                t = f.transform(t)
            return t

        return Fitted(apply, {"steps": done})
