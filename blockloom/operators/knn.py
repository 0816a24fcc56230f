"""Gower nearest neighbours: classification, regression and imputation, by exact search in trees of bounded boxes."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import BlockTable, clean, present

#: Training rows, and values of them, that executors hold at a time; more are dealt out in parts by a hash.
BROADCAST_ROWS, HELD_VALUES = 1_000_000, 8_000_000
#: Rows of a leaf of the search tree.
LEAF = 256


def ranges(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Of each numeric column its range; 1 where that isn't positive and finite."""
    if not numeric:
        return {}
    got = train.agg(*[(F.max(clean(c)) - F.min(clean(c))).alias(f"r{i}") for i, c in enumerate(numeric)]).first()
    return {c: float(got[f"r{i}"]) if got[f"r{i}"] is not None and 0 < got[f"r{i}"] < float("inf") else 1.0 for i, c in enumerate(numeric)}


def ordered_code(col: str, levels: list[str]) -> Column:
    """An ordered level's place on [0, 1]; 0 for a single level."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(col).cast("string"))
    return F.when(at > 0, (at - 1) / F.lit(float(max(len(levels) - 1, 1))))


def neighbours(test: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str], k: int = 5, min_feature_frac: float = 0.2, ordered: dict[str, list[str]] | None = None, na_handling: str = "pairwise", keep: tuple[str, ...] = (), span: dict[str, float] | None = None) -> DataFrame:
    """test_id, train_id, dist, nn and train's ``keep`` columns for each test row's k nearest training rows.

    test has test_id, train has train_id.  The distance is the mean over the features that both
    rows have of |a - b| / range, or of 0 or 1 for categories; pairs with fewer than
    min_feature_frac of the features don't count.  Equal distances go by train_id.  Executors hold
    the training table as a tree, BROADCAST_ROWS at a time, and a test row is set against the leaves that
    may hold one of its k nearest and no others; of several parts the k best of each are ranked.
    """
    ordered = ordered or {}
    if na_handling == "fail":
        for df in (test, train):
            if not df.where(~F.lit(True) if not (numeric or categorical) else ~present_all([*numeric, *ordered], categorical)).isEmpty():
                raise ValueError("missing values")
    span = span or ranges(train, numeric)
    side = lambda df, p: df.select(F.col(f"{p}_id"), *[clean(c).alias(f"{p}_n{i}") for i, c in enumerate(numeric)], *[ordered_code(c, v).alias(f"{p}_o{i}") for i, (c, v) in enumerate(ordered.items())], *[F.col(c).cast("string").alias(f"{p}_c{i}") for i, c in enumerate(categorical)], *[F.col(c) for c in keep if p == "train"])
    a, b = side(test, "test"), side(train, "train")
    terms = len(numeric) + len(ordered) + len(categorical)
    least = max(1, -int(-min_feature_frac * terms // 1))
    parts = max(1, -(-train.count() // max(1, min(BROADCAST_ROWS, HELD_VALUES // max(terms, 1)))))
    a = a.repartition(2 * a.sparkSession.sparkContext.defaultParallelism, "test_id")
    search = lambda own: _against_all(a, own, [span[c] for c in numeric], len(ordered), len(categorical), k, least, keep)
    if parts == 1:
        return search(b)
    found = reduce(DataFrame.unionAll, [search(b.where(F.pmod(F.xxhash64("train_id"), F.lit(parts)) == i)) for i in range(parts)])
    found = found.withColumn("nn", F.row_number().over(Window.partitionBy("test_id").orderBy("dist", "train_id"))).where(F.col("nn") <= k)
    return found.select("test_id", "train_id", "dist", "nn", *keep)


def _tree(x: np.ndarray, codes: np.ndarray, scale: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows and the leaves' first places in it: rows of a leaf lack the same features, and are near each other.

    x has a row for each number (NaN: missing), codes one for each category (-1: missing).
    """
    n = x.shape[1] if len(x) else codes.shape[1]
    order = np.arange(n)
    lacks = np.concatenate([np.isnan(x), codes == -1])
    if lacks.any():
        order = np.lexsort(lacks)
        cuts = np.flatnonzero((lacks[:, order[1:]] != lacks[:, order[:-1]]).any(axis=0)) + 1
    else:
        cuts = np.zeros(0, np.int64)
    ends = np.r_[0, cuts, n]
    todo, firsts = list(zip(ends[:-1], ends[1:], strict=True)), []
    while todo:
        i, j = todo.pop()
        if j - i <= LEAF:
            firsts.append(i)
            continue
        own, widest, at = order[i:j], 0.0, None
        for c in range(len(codes)):
            v = codes[c, own]
            if 1.0 > widest and v.min() != v.max():
                widest, at = 1.0, len(x) + c
        for c in range(len(x)):
            v = x[c, own]
            wide = 0.0 if np.isnan(v[0]) else (v.max() - v.min()) / scale[c]
            if wide > widest:
                widest, at = wide, c
        if at is None:
            # Rows that are all alike: in pieces by their ids, of which only the first can be near.
            order[i:j] = np.sort(own)
            firsts += range(i, j, LEAF)
            continue
        v = x[at, own] if at < len(x) else codes[at - len(x), own]
        by = np.lexsort((own, v))
        order[i:j], v = own[by], v[by]
        middle = len(v) // 2
        low, high = np.searchsorted(v, v[middle], "left"), np.searchsorted(v, v[middle], "right")
        cut = i + int(low if low and (middle - low <= high - middle or high == len(v)) else high)
        todo += [(i, cut), (cut, j)]
    return order, np.array(sorted(firsts), np.int64)


def _against_all(test: DataFrame, train: DataFrame, spans: list[float], n_ordered: int, n_categorical: int, k: int, least: int, keep: tuple[str, ...], cells: int = 1 << 20) -> DataFrame:
    """neighbours() of test rows against a training table small enough to hold: bounds to all leaves, at most ``cells`` at a time, and distances to the rows of leaves within them."""
    spark = test.sparkSession
    plain = [f"n{i}" for i in range(len(spans))] + [f"o{i}" for i in range(n_ordered)]
    scale = [*spans, *[1.0] * n_ordered]

    def numbers(col) -> np.ndarray:
        return pc.fill_null(pc.cast(col, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)

    def coded(col, known: dict) -> np.ndarray:
        seen = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode()
        place = np.array([known.get(v, -2) for v in seen.dictionary.to_pylist()] + [-1], np.int64)
        return place[pc.fill_null(seen.indices, len(place) - 1).to_numpy(zero_copy_only=False)]

    def built() -> dict:
        """The training rows by train_id, and their numbers and codes in the tree's order."""
        b = train.orderBy("train_id").toArrow().combine_chunks()
        known = [{v: i for i, v in enumerate(pc.unique(b[f"train_c{i}"]).to_pylist()) if v is not None} for i in range(n_categorical)]
        x = np.array([numbers(b[f"train_{c}"]) for c in plain]).reshape(len(plain), b.num_rows)
        codes = np.array([coded(b[f"train_c{i}"], known[i]) for i in range(n_categorical)], np.int64).reshape(n_categorical, b.num_rows)
        order, firsts = _tree(x, codes, scale) if b.num_rows and len(x) + len(codes) else (np.arange(b.num_rows), np.zeros(min(b.num_rows, 1), np.int64))
        x, codes = x[:, order], codes[:, order]
        box = [f.reduceat(v, firsts, axis=1) if len(firsts) else v for v in (x, codes) for f in (np.minimum, np.maximum)]
        return {"rows": b.select(["train_id", *keep]), "known": known, "x": x, "codes": codes, "order": order, "firsts": firsts, "ends": np.r_[firsts[1:], b.num_rows].astype(np.int64) if len(firsts) else firsts, "box": box, "least": np.minimum.reduceat(order, firsts) if len(firsts) else firsts}

    held = spark.sparkContext.broadcast(built())

    def apart(u, v, low, high, lows, highs):
        """total and used of test numbers u and codes v from what lies between bounds; where bounds are equal, of rows."""
        total, used = 0.0, 0
        for i, s in enumerate(scale):
            d = np.maximum(np.maximum(low[i] - u[i], u[i] - high[i]), 0.0) / s
            both = ~np.isnan(d)
            total, used = total + np.where(both, d, 0.0), used + both
        for i in range(n_categorical):
            both = (v[i] != -1) & (lows[i] != -1)
            total, used = total + np.where(both & ((v[i] < lows[i]) | (v[i] > highs[i])), 1.0, 0.0), used + both
        return np.where(used >= least, total / np.maximum(used, 1), np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        x, codes, order, firsts, ends = t["x"], t["codes"], t["order"], t["firsts"], t["ends"]
        names = ["test_id", "train_id", "dist", "nn", *keep]
        for batch in batches:
            u = np.array([numbers(batch.column(f"test_{c}")) for c in plain]).reshape(len(plain), batch.num_rows)
            v = np.array([coded(batch.column(f"test_c{i}"), t["known"][i]) for i in range(n_categorical)], np.int64).reshape(n_categorical, batch.num_rows)
            step = max(1, cells // max(len(firsts), 1))
            for at in range(0, batch.num_rows if len(firsts) and len(x) + len(codes) else 0, step):
                bounds = apart(u[:, at : at + step, None], v[:, at : at + step, None], *[b[:, None, :] for b in t["box"]])
                rows, cols, dists, ranks = [], [], [], []
                for r, bound in enumerate(bounds):
                    i = at + r
                    near, far = (np.zeros(0), np.zeros(0, np.int64)), np.inf
                    done, take = np.zeros(0, np.int64), 1
                    left = np.flatnonzero(bound < np.inf)
                    while len(left):
                        if take < len(left):
                            part = np.argpartition(bound[left], take - 1)
                            done, left = left[part[:take]], left[part[take:]]
                        else:
                            done, left = left, left[:0]
                        spot = np.concatenate([np.arange(a, b) for a, b in zip(firsts[done], ends[done], strict=True)])
                        own = x[:, spot], codes[:, spot]
                        d = np.concatenate([near[0], apart(u[:, i], v[:, i], own[0], own[0], own[1], own[1])])
                        ids = np.concatenate([near[1], order[spot]])
                        if len(d) > k:
                            fit = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                            d, ids = d[fit], ids[fit]
                        by = np.lexsort((ids, d))[:k]
                        by = by[d[by] < np.inf]
                        near = d[by], ids[by]
                        if len(by) == k:
                            far = near[0][-1]
                            left = left[(bound[left] < far) | (bound[left] == far) & (t["least"][left] < near[1][-1])]
                        take *= 2
                    rows.append(np.full(len(near[0]), i))
                    cols.append(near[1])
                    dists.append(near[0])
                    ranks.append(np.arange(1, len(near[0]) + 1, dtype=np.int32))
                i, j, d, nn = (np.concatenate(z) for z in (rows, cols, dists, ranks))
                found = t["rows"].take(pa.array(j))
                kept = [found[c].combine_chunks() for c in ("train_id", *keep)]
                yield pa.RecordBatch.from_arrays([batch.column("test_id").take(pa.array(i)), kept[0], pa.array(d), pa.array(nn), *kept[1:]], names)

    kinds = dict(train.dtypes) | dict(test.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("test_id", "train_id")) + ", dist double, nn int" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return test.mapInArrow(run, schema)


def present_all(numeric: list[str], categorical: list[str]) -> Column:
    ok = F.lit(True)
    for c in numeric:
        ok = ok & present(c)
    for c in categorical:
        ok = ok & F.col(c).isNotNull()
    return ok


def _weight(weights: str) -> Column:
    return F.lit(1.0) if weights == "uniform" else 1 / (F.col("dist") + 1e-12)


def _checked(train: DataFrame, known: Column, target: str, missing_target: str, k: int) -> DataFrame:
    """train's rows with a target; missing_target "fail" raises where some lack one, and fewer rows than k give a warning."""
    n, m = train.agg(F.count(F.when(known, 1)), F.count("*")).first()
    if missing_target == "fail" and n < m:
        raise ValueError(f"{m - n} training rows have no {target}")
    if not n:
        raise ValueError("no training row has a target")
    if k > n:
        warnings.warn(f"k is {k}, but there are {n} training rows", stacklevel=3)
    return train.where(known)


def _of_all(test: DataFrame, got: DataFrame, no_neighbours: str) -> DataFrame:
    """got with a row for each test row: null without neighbours, or an error if no_neighbours is "fail"."""
    out = test.select("test_id").join(got, "test_id", "left")
    if no_neighbours == "fail":
        out = out.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("no neighbour with enough features for "), F.col("test_id").cast("string")))).otherwise(F.col("response")))
    return out


def classify(test: DataFrame, train: DataFrame, target: str, numeric: list[str], categorical: list[str] = (), k: int = 5, weights: str = "inverse", levels: tuple[str, ...] = (), missing_target: str = "drop", no_neighbours: str = "null", **options) -> DataFrame:
    """test_id, response (the first level among equals) and a probability for each level; unobserved levels have probability 0.

    Every test row comes out; one without neighbours has nulls, or raises (no_neighbours "fail").
    """
    train = _checked(train, F.col(target).isNotNull(), target, missing_target, k)
    found = neighbours(test, train, list(numeric), list(categorical), k, keep=(target,), **options)
    levels = list(levels) or sorted(str(r[0]) for r in train.select(target).where(F.col(target).isNotNull()).distinct().collect())
    w = _weight(weights)
    prob = [(F.sum(F.when(F.col(target).cast("string") == v, w).otherwise(0.0)) / F.sum(w)).alias(f"prob_{v}") for v in levels]
    out = found.groupBy("test_id").agg(*prob)
    best = F.greatest(*[F.col(f"`prob_{v}`") for v in levels]) if len(levels) > 1 else F.col(f"`prob_{levels[0]}`")
    response = F.coalesce(*[F.when(F.col(f"`prob_{v}`") == best, F.lit(v)) for v in levels])
    return _of_all(test, out.withColumn("response", response), no_neighbours)


def regress(test: DataFrame, train: DataFrame, target: str, numeric: list[str], categorical: list[str] = (), k: int = 5, weights: str = "inverse", missing_target: str = "drop", no_neighbours: str = "null", **options) -> DataFrame:
    """test_id, response (weighted mean) and se (root of the weighted variance); every test row comes out, as with classify."""
    train = _checked(train, present(target), target, missing_target, k)
    found = neighbours(test, train, list(numeric), list(categorical), k, keep=(target,), **options)
    w, y = _weight(weights), F.col(target).cast("double")
    got = found.groupBy("test_id").agg((F.sum(w * y) / F.sum(w)).alias("response"), (F.sum(w * y * y) / F.sum(w)).alias("__q"))
    out = got.select("test_id", "response", F.sqrt(F.greatest(F.col("__q") - F.col("response") ** 2, F.lit(0.0))).alias("se"))
    return _of_all(test, out, no_neighbours)


@dataclass
class KnnImpute:
    """Fills missing values of block columns from the k nearest training rows that have them, by the other block columns."""

    k: int = 5

    def fit(self, table: BlockTable):
        from .preprocess import Fitted

        train, rid = table, table.row_id

        def apply(t: BlockTable) -> BlockTable:
            kinds = {c: t.df.schema[c].dataType.typeName() for c in t.columns}
            numeric = [c for c in t.columns if kinds[c] != "string"]
            df = t.df
            gaps = {c: ~present(c) if c in numeric else F.col(c).isNull() for c in t.columns}
            some = df.agg(*[F.max(g).alias(f"g{i}") for i, g in enumerate(gaps.values())]).first()
            for c in [c for i, c in enumerate(t.columns) if some[f"g{i}"]]:
                gap = gaps[c]
                need = t.df.where(gap).withColumnRenamed(rid, "test_id")
                have = train.df.where(~gap).withColumnRenamed(rid, "train_id")
                others = [x for x in numeric if x != c], [x for x in t.columns if x not in numeric and x != c]
                got = regress(need, have, c, *others, k=self.k) if c in numeric else classify(need, have, c, *others, k=self.k)
                fill = got.select(F.col("test_id").alias("__id"), F.col("response").alias("__fill"))
                value = F.coalesce(clean(c) if c in numeric else F.col(c), F.col("__fill"))
                df = df.join(fill, F.col(rid) == F.col("__id"), "left").withColumn(c, value).drop("__id", "__fill")
            return t.with_df(df)

        return Fitted(apply)
