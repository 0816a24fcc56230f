"""SimHash near-duplicates, found by tables of distances to reference fingerprints (pivots).

A document's fingerprint has a bit set where more than half the hashes of its word shingles have
it set.  Documents with equal fingerprints are one from here on.  Two fingerprints that differ in
at most ``radius`` bits agree on all but ``radius`` of ``radius + 2`` blocks of bits, so they meet
in the bucket of some pair of blocks.  In a bucket, the pivot table decides which pairs are looked
at: by the triangle inequality the distances of the two to any pivot differ by ``radius`` at most,
so a pair whose largest difference over all pivots is more is discarded, and the rest verified.
A bucket sends on only a spanning forest of its links.  Buckets of more than ``crowd``
fingerprints, where looking at all pairs would not pay, are linked in an exact other way: two
fingerprints that differ in at most two bits share a neighbour that differs from each in at most
one, so all fingerprints around one neighbour are linked to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, written
from .components import components

PIVOTS = 32


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: odd multiples of a constant, mixed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def fingerprint(text: str, size: int = 3) -> int:
    """Of a text, by the unsigned XXH64 (seed 42) of its lower-cased shingles; 0 for no words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = WORD.findall(ascii_lower(text))
    if not words:
        return 0
    if len(words) < size:
        return h(" ".join(words), 42)
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, 1 << 14):
        part = words[at : at + (1 << 14) + size - 1]
        shingles = map(" ".join, zip(*[part[i:] for i in range(size)], strict=False))
        hashes = np.array([h(x, 42) for x in shingles], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, key: str | None = None) -> DataFrame:
    """(doc_id, fp, row_key): fp is the fingerprint as a signed long, row_key a long column named by key, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or "", size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], ["doc_id", "fp", "row_key"])

    carried = (F.lit(None) if key is None else F.col(f"`{key}`")).cast("bigint").alias("row_key")
    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text"), carried).mapInArrow(run, "doc_id bigint, fp bigint, row_key bigint")


def _forest(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (rows sorted by key) as a star around each part's first row."""
    n = len(keys)
    parent = np.arange(n)
    left = np.arange(n)
    for step in range(1, n):
        left = left[left < n - step]
        left = left[keys[left] == keys[left + step]]
        if not len(left):
            break
        near = left[np.abs(table[left] - table[left + step]).max(axis=1) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        while len(near):
            a, b = parent[near], parent[near + step]
            near = near[a != b]
            if len(near):
                a, b = parent[near], parent[near + step]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    linked = parent != np.arange(n)
    return fps[linked], fps[parent[linked]]


def links(distinct: DataFrame, radius: int = 2, crowd: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all fp of distinct that lie within radius of each other; radius is at most 2."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    width = 64 // (radius + 2)
    blocks = [((1 << (64 - width * (radius + 1) if i == radius + 1 else width)) - 1) << (width * i) for i in range(radius + 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(a | b) for a, b in combinations(blocks, 2)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["mask", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        rest = np.empty((0, 3), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            fps = rows[:, 2].copy().view(np.uint64)
            table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
            a, b = _forest(np.cumsum(new), fps, table, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            upto = len(rows) if not last.any() else int(np.argmax(last))
            rest = rows[upto:]
            if upto:
                yield found(rows[:upto])
        if len(rest):
            yield found(rest)

    few = met.where(F.col("n") <= crowd).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a bigint, b bigint")
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]
    around = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("near"))
    centre = around.groupBy("near").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    many = around.join(centre, "near").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    if radius < 2:
        many = many.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return few.union(many)


def simhash_components(docs: DataFrame, text: str = "text", size: int = 3, radius: int = 2, crowd: int = 4096, key: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) and, if key names a long column, row_key.

    A null text counts as empty; all documents without words have fingerprint zero and are linked
    as any others.  Repeated rows come out as often as they stand there.  Null doc_ids keep their
    rows and never name a component.  An empty table gives an empty result.  Other columns of
    docs are not read.
    """
    own = written(fingerprints(docs, text, size, key), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, radius, crowd))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    final = placed.join(named, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return own.join(final, "fp").select("doc_id", hexed, "component_id", *(["row_key"] if key else []))
