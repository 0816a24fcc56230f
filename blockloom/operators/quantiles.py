"""Exact quantiles by group of any number of rows.

Two passes: every STEP-th order statistic of each chunk of rows brackets the wanted ranks, and then
only the values inside the brackets are shuffled, as counts, with the number of those between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a chunk's sorted values each STEP-th is a point; a chunk has at most CELLS values.
STEP, CELLS = 32, 1 << 22


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; zeros are one, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """group, column and the chunk's sorted keys, nulls left out."""
    held, rows = {}, 0

    def sorted_out():
        for (g, c), parts in held.items():
            yield g, c, np.sort(np.concatenate(parts))
        held.clear()

    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        names, code = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False)
        for c in range(batch.num_columns - 1):
            x = batch.column(c + 1)
            there = pc.is_valid(x).to_numpy(zero_copy_only=False)
            keys = _keys(x.to_numpy(zero_copy_only=False).astype(float))
            for i, g in enumerate(names):
                own = keys[there & (code == i)]
                if len(own):
                    held.setdefault((g, c), []).append(own)
        rows += batch.num_rows
        if rows * (batch.num_columns - 1) >= CELLS:
            yield from sorted_out()
            rows = 0
    yield from sorted_out()


def _brackets(points: np.ndarray, chunks: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals, ends included, that hold the order statistics of the ranks (from 0).

    At most STEP * i values are less than the i-th point, and at least STEP * (i + 1) - chunks *
    (STEP - 1) are no greater.
    """
    low = points[np.minimum(ranks // STEP, len(points) - 1)]
    at = -(-(ranks + 1 + chunks * (STEP - 1)) // STEP) - 1
    high = np.where(at < len(points), points[np.minimum(at, len(points) - 1)], np.iinfo(np.int64).max)
    new = np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]]
    return low[new], np.maximum.reduceat(high, np.flatnonzero(new))


def grouped_quantiles(df: DataFrame, group: str, cols: list[str], probs: list[float]) -> dict[tuple[str, str], list[float]]:
    """Of each group (as text; null is none) and column the quantiles at probs, interpolated as percentile does; groups without values of a column are left out."""
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    probs = np.array(probs, float)

    def places(n: int) -> np.ndarray:
        return (n - 1) * probs

    def ranks(n: int) -> np.ndarray:
        return np.unique(np.r_[np.floor(places(n)), np.ceil(places(n))].astype(np.int64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, keys in _chunks(batches):
            yield pa.RecordBatch.from_pylist([{"g": g, "c": c, "n": len(keys), "points": keys[::STEP].tobytes()}], pa.schema([("g", pa.string()), ("c", pa.int32()), ("n", pa.int64()), ("points", pa.binary())]))

    def bracket(t: pa.Table) -> pa.Table:
        points = np.sort(np.concatenate([np.frombuffer(b, np.int64) for b in t["points"].to_pylist()]))
        n = pc.sum(t["n"]).as_py()
        low, high = _brackets(points, t.num_rows, ranks(n))
        return pa.table({"g": t["g"].slice(0, 1), "c": t["c"].slice(0, 1), "n": pa.array([n], pa.int64()), "low": pa.array([low.tolist()], pa.list_(pa.int64())), "high": pa.array([high.tolist()], pa.list_(pa.int64()))})

    found = rows.mapInArrow(sketch, "g string, c int, n bigint, points binary").groupBy("g", "c").applyInArrow(bracket, "g string, c int, n bigint, low array<bigint>, high array<bigint>").collect()
    within = {(r["g"], r["c"]): (r["n"], np.array(r["low"], np.int64), np.array(r["high"], np.int64)) for r in found}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, keys in _chunks(batches):
            _, low, high = within[g, c]
            first, end = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            inside, n = np.unique(np.concatenate([keys[a:b] for a, b in zip(first, end, strict=True)]), return_counts=True)
            gaps = first - np.r_[0, end[:-1]]
            yield pa.RecordBatch.from_pylist([{"g": g, "c": c, "keys": inside.tobytes(), "n": n.astype(np.int64).tobytes(), "gaps": gaps.astype(np.int64).tobytes()}], pa.schema([("g", pa.string()), ("c", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("gaps", pa.binary())]))

    def settle(t: pa.Table) -> pa.Table:
        g, c = t["g"][0].as_py(), t["c"][0].as_py()
        n, low, _ = within[g, c]
        whole = lambda name: [np.frombuffer(b, np.int64) for b in t[name].to_pylist()]
        keys, own = np.concatenate(whole("keys")), np.concatenate(whole("n"))
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        before = np.cumsum(np.sum(whole("gaps"), axis=0))
        upto = np.cumsum(own) + before[np.searchsorted(low, keys, "right") - 1]
        place = places(n)
        a, b = (_doubles(keys[np.searchsorted(upto, f(place).astype(np.int64) + 1, "left")]) for f in (np.floor, np.ceil))
        with np.errstate(invalid="ignore"):
            q = np.where((np.floor(place) == np.ceil(place)) | (a == b), a, (np.ceil(place) - place) * a + (place - np.floor(place)) * b)
        return pa.table({"g": t["g"].slice(0, 1), "c": t["c"].slice(0, 1), "q": pa.array([q.tolist()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(count, "g string, c int, keys binary, n binary, gaps binary").groupBy("g", "c").applyInArrow(settle, "g string, c int, q array<double>").collect()
    return {(r["g"], cols[r["c"]]): list(r["q"]) for r in got}
