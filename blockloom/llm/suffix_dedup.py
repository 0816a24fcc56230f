"""Exact substring removal over a sparse suffix array.

A string of ``size`` bytes that stands in two documents has its least 16-byte gram (by hash) at
the same place in both.  So of all suffixes only those at such anchors are taken, one for some
eighteen bytes, each standing for the run of strings whose anchor it is:

1. Anchors are dealt into buckets by their gram's hash as packed arrays.  There, runs that are
   equal as a whole are settled at once: all but those of the least document repeat.  Documents
   of one batch are settled before anything is sent, so copies of a text cost one entry a batch.
   Grams that only one document has are dropped.
2. What remains are runs that share a gram but not everything, at the edges of repeats: one for
   each different run.  Their bytes are fetched.  Sampled splitters range-partition their
   suffixes by the leading bytes, so that equal grams never lie across a boundary and no string
   has to be compared over one.  Each bucket sorts its suffixes by multikey quicksort, word by
   word, takes the common prefixes of neighbours, and for each distance to the left of the anchor
   splits the groups of equal suffixes by the bytes before it.  Every string of a group repeats
   in all documents but the least.

Equality in step 1 is that of two hashes (104 bits); step 2 compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, written
from .packed import Blob, packed

GRAM = 16
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
KEY_BITS = 40
#: Bytes whose hashes are computed at a time.
SEGMENT = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, in place; the tail means nothing."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v[:-step] = np.minimum(v[:-step], v[step:])
        have += step
    return v


def anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, starts after it, anchor, gram hash, run hash) of every run of strings of ``size`` bytes; places count within their text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    x = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
    sums = np.zeros(len(x) + 1, np.uint64)
    sums[1:] = BYTE_VALUES[x]
    sums[1:] *= _powers(BASE, len(x))
    np.cumsum(sums, out=sums)
    back = _powers(BASE_INVERSE, len(x) + 1)
    grams = sums[GRAM:] - sums[:-GRAM]
    grams *= back[:-GRAM]
    grams = _mixed(grams)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = grams & ~low
    least |= np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(least, size - GRAM + 1)
    counts = np.maximum(sizes - size + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(len(text)) + np.repeat(ends - sizes - np.cumsum(counts) + counts, counts)
    place = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    more = np.append(first[1:], len(starts)) - 1 - first
    begin, at, which = starts[first], place[first], text[first]
    long = more + size
    run = (sums[begin + long] - sums[begin]) * back[begin]
    run = _mixed(run + _mixed(((at - begin) << 32 | long).astype(np.uint64)))
    return which, begin - (ends - sizes)[which], more, at - (ends - sizes)[which], grams[at], run


def _segments(texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, place, part) of all texts, some SEGMENT bytes at a time; a text's parts share size - 1 bytes, so each string starts in one."""
    held, n = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), SEGMENT):
            part = t[at : at + SEGMENT + size - 1] if len(t) > SEGMENT else t
            held.append((i, at, part))
            n += len(part)
            if n >= SEGMENT:
                yield held
                held, n = [], 0
    if held:
        yield held


def all_anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """What anchors gives, for texts of any length in bounded memory."""
    found = []
    for parts in _segments(texts, size):
        which, start, more, at, gram, run = anchors([x for *_, x in parts], size)
        number, place = (np.array([x[i] for x in parts], np.int64)[which] for i in range(2))
        found.append((number, start + place, more, at + place, gram, run))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _group_heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sent(ids: np.ndarray, rows: np.ndarray, texts: list[bytes], size: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) rows of a batch of documents; a negative bucket's blob has runs that repeat for certain."""
    which, start, more, at, gram, run = all_anchors(texts, size)
    # Mixed again, since the least hash of some is a small one, and keys are to be spread evenly.
    doc, key = ids[which], _mixed(gram * MIX) >> np.uint64(64 - KEY_BITS)
    order = np.lexsort((doc, run, key))
    doc, key, run, which, start, more, at = (v[order] for v in (doc, key, run, which, start, more, at))
    head = _group_heads(key, run)
    lead = np.repeat(doc[head], np.diff(np.append(head, len(doc))))
    again = doc > lead
    if again.any():
        yield -1 - int(abs(int(rows[0])) % buckets), packed(rows[which[again]].view(np.uint64), start[again], more[again] + 1)
    keep = ~again
    doc, key, run, which, start, more, at = (v[keep] for v in (doc, key, run, which, start, more, at))
    bucket = (key * np.uint64(buckets)) >> np.uint64(KEY_BITS) if buckets < 1 << (64 - KEY_BITS) else key % np.uint64(buckets)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket):
        s = slice(edges[int(b)], edges[int(b) + 1])
        used, number = np.unique(which[s], return_inverse=True)
        keys = key[s]
        yield int(b), packed(ids[used].view(np.uint64), rows[used].view(np.uint64), np.diff(keys, prepend=np.uint64(0)), run[s], number, start[s], more[s], at[s] - start[s])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of doc_id and text, which names the row) and z, the compressed bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(x.as_py()) for x in batch.column(2)], pa.binary())], ["doc_id", "row", "z"])

    return docs.select("doc_id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, row bigint, z binary")


RUN_COLUMNS = ["row", "at", "before", "more"]


def _judged(blobs: list[bytes]) -> pa.RecordBatch:
    """A bucket's runs: those that repeat for certain (before is -1, at the first start) and those to look at (at is the anchor)."""
    read = [Blob(b) for b in blobs]
    keys = [np.cumsum(b[2]) for b in read]
    sizes = np.cumsum([0, *map(len, keys)])
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    del order, same
    parts = []  # only of keys that come more than once
    for i, b in enumerate(read):
        mine = often[sizes[i] : sizes[i + 1]]
        number = b[4][mine].astype(np.int64)
        parts.append((b[3][mine], b[0].view(np.int64)[number], b[1].view(np.int64)[number], *[b[j][mine].view(np.int64) for j in (5, 6, 7)]))
    key = key[often]
    run, doc, row, start, more, before = (np.concatenate(v) for v in zip(*parts, strict=True))
    del parts, read
    order = np.lexsort((doc, run, key))
    key, run, doc, row, start, more, before = (v[order] for v in (key, run, doc, row, start, more, before))
    if not len(key):
        return _run_batch(row, start, before, more)
    by_key, by_run = _group_heads(key), _group_heads(key, run)
    of_key = np.repeat(np.arange(len(by_key)), np.diff(np.append(by_key, len(key))))
    of_run = np.repeat(np.arange(len(by_run)), np.diff(np.append(by_run, len(key))))
    several_docs = np.minimum.reduceat(doc, by_key) < np.maximum.reduceat(doc, by_key)
    several_runs = np.bincount(of_key[by_run], minlength=len(by_key)) > 1
    again = doc > doc[by_run][of_run]
    look = ~again & (several_docs & several_runs)[of_key]
    at = np.where(look, start + before, start)
    some = again | look
    return _run_batch(row[some], at[some], np.where(look, before, -1)[some], np.where(look, more, more + 1)[some])


def _parts(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _run_batch(row, at, before, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (row, at, before, more)], RUN_COLUMNS)


def _settled(docs: DataFrame, size: int, bucket_bytes: int, batch_bytes: int) -> DataFrame:
    """row, at, before, more of the runs that _judged tells of, for all documents.

    The number of buckets follows from the bytes of all texts, so a bucket's size doesn't grow
    with the table.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            sent = list(_sent(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), [h[2] for h in held], size, buckets))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.binary())], ["bucket", "blob"])

        held, n = [], 0
        for batch in batches:
            for doc_id, row, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                if len(text) < size:
                    continue
                held.append((doc_id.as_py(), row.as_py(), text))
                n += len(text)
                if n >= batch_bytes:
                    yield out(held)
                    held, n = [], 0
                    released()
        if held:
            yield out(held)
        released()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    row, start, more = (Blob(blob.as_py())[i].view(np.int64) for i in range(3))
                    yield _run_batch(row, start, np.full(len(row), -1), more)
                    continue
                if bucket != now and blobs:
                    yield from _parts(_judged(blobs))
                    blobs = []
                    released()
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from _parts(_judged(blobs))
        released()

    sent = docs.select("doc_id", "row", F.col("text").cast("binary")).mapInArrow(send, "bucket bigint, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, "row bigint, at bigint, before bigint, more bigint")


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned words, by multikey quicksort: sort by one word, then each group of equals by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for j in range(1, words.shape[1]):
        w = words[order, j - 1]
        new = np.zeros(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        equal = np.append(~new[1:], False) | np.append(False, ~new[1:]) if len(order) > 1 else np.zeros(len(order), bool)
        at = np.flatnonzero(equal)
        if not len(at):
            break
        order[at] = order[at][np.lexsort((words[order[at], j], group[at]))]
    return order


def repeats(strings: list[bytes], before: np.ndarray, more: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """repeats[i, s]: whether string i's substring of ``size`` bytes that starts s bytes before its anchor is in a string of a lesser document, at the same distance from an anchor."""
    n, far = len(strings), size - GRAM + 1
    lengths = np.array([len(x) for x in strings], np.int64)
    flat = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    anchor = np.cumsum(lengths) - lengths + before
    span = lengths - before
    reach = np.arange(size)
    right = np.where(reach < span[:, None], flat[np.minimum(anchor[:, None] + reach, len(flat) - 1)], 0).astype(np.uint8)
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = right
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    right, doc, before, first = right[order], doc[order], before[order], (before - more)[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    left = np.zeros((n, far), np.uint8)
    for s in range(1, far):
        left[:, s] = np.where(s <= before, flat[np.maximum(anchor[order] - s, 0)], 0)
    found = np.zeros((n, far), bool)
    hashed = np.zeros(n, np.uint64)
    for s in range(far):
        if s:
            hashed = _mixed(hashed + BYTE_VALUES[left[:, s]])
        rows = np.flatnonzero((first <= s) & (s <= before))
        if len(rows) < 2:
            continue
        group = np.concatenate([[0], np.cumsum(common < size - s)])[rows]
        by = np.lexsort((doc[rows], hashed[rows], group))
        rows, group = rows[by], group[by]
        head = _group_heads(group, hashed[rows])
        tied = np.ones(len(rows), bool)
        tied[head] = False
        tied = np.flatnonzero(tied)
        if s and (left[rows[tied], 1 : s + 1] != left[rows[tied - 1], 1 : s + 1]).any():  # equal hashes of other bytes: go by the bytes
            by = np.lexsort((doc[rows], *left[rows, 1 : s + 1].T, group))
            rows, group = rows[by], group[by]
            head = _group_heads(group, *left[rows, 1 : s + 1].T)
        lead = np.repeat(doc[rows[head]], np.diff(np.append(head, len(rows))))
        found[rows, s] = doc[rows] > lead
    out = np.zeros((n, far), bool)
    out[order] = found
    return out


def _edges(docs_z: DataFrame, look: DataFrame, size: int, part_rows: int) -> DataFrame:
    """row, start, count: the strings of the runs to look at that repeat."""
    asked = look.groupBy("row").agg(F.collect_list(F.struct("at", "before", "more")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols, strings, size_now = [[], [], [], [], []], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(v)) for v in cols], pa.array(strings, pa.binary())], ["row", "doc_id", "at", "before", "more", "string"])

            for row, doc_id, z, runs in zip(*batch.columns, strict=True):
                x, k = unpack.decompress(z.as_py()), runs.values
                at, before, more = (k.field(i).to_numpy() for i in range(3))
                for held, v in zip(cols, (np.full(len(at), row.as_py()), np.full(len(at), doc_id.as_py()), at, before, more), strict=True):
                    held.append(v)
                strings += [x[p - b : p - b + m + size] for p, b, m in zip(at.tolist(), before.tolist(), more.tolist(), strict=True)]
                size_now += len(at)
                if size_now >= 50_000:
                    yield out()
                    cols, strings, size_now = [[], [], [], [], []], [], 0
            if strings:
                yield out()

    with arrow_rows(look.sparkSession, 250):
        strings = written(docs_z.join(asked, "row").select("row", "doc_id", "z", "runs").mapInArrow(cut, "row bigint, doc_id bigint, at bigint, before bigint, more bigint, string binary"), "suffixes")
    parts = int(max(1, -(-strings.count() // part_rows)))
    lead = F.call_function("substring", F.col("string"), (F.col("before") + 1).cast("int"), F.lit(GRAM))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        row, doc, at, before, more = (table.column(i).to_numpy() for i in range(5))
        found = repeats(table.column(5).to_pylist(), before, more, doc, size)
        # Runs of distances s to s + count - 1 are starts from at - s - count + 1 on.
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, s = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (row[i], at[i] - e + 1, (e - s).astype(np.int64))], ["row", "start", "count"])
        del held, table, found
        released()

    return strings.repartitionByRange(parts, lead).mapInArrow(find, "row bigint, start bigint, count bigint")


def substring_spans(docs: DataFrame, size: int = 50, bucket_bytes: int = 8 << 20, batch_bytes: int = 1 << 20, part_rows: int = 40_000) -> DataFrame:
    """row, spans (array of start << 12 | count): the strings of ``size`` bytes that also start in a document of a lesser doc_id.

    docs has doc_id (not null), row and text (not null).
    """
    if size < 2 * GRAM:
        raise ValueError(f"size must be at least {2 * GRAM}")
    with arrow_rows(docs.sparkSession, 250):
        runs = written(_settled(docs, size, bucket_bytes, batch_bytes), "suffix-runs")
    edges = _edges(_keyed(docs), runs.where("before >= 0"), size, part_rows)
    sure = runs.where("before < 0").select("row", F.col("at").alias("start"), F.col("more").alias("count"))
    packed = (F.call_function("shiftleft", F.col("start"), F.lit(12)) + F.col("count")).alias("span")
    return sure.union(edges).select("row", packed).groupBy("row").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", size: int = 50, with_text: bool = True, **options) -> DataFrame:
    """Removes every byte covered by a string of ``size`` bytes that also starts in a document of a lesser doc_id.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with_text, kept (binary: a removed run may end inside a character).  A null text counts as
    empty.  Documents of equal doc_id don't remove from each other; rows without doc_id lose
    nothing and make nothing repeat.  An empty table gives an empty result; other columns are not
    read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = substring_spans(docs.where("doc_id is not null"), size, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for z, packed in zip(batch.column(1), batch.column(2), strict=True):
                x = unpack.decompress(z.as_py())
                kept, removed, n, upto = x, 0, 0, 0
                if packed.is_valid and len(packed):
                    v = np.sort(packed.values.to_numpy())
                    start, end = v >> 12, (v >> 12) + (v & 4095) + size - 1
                    far = np.maximum.accumulate(end)
                    head = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
                    parts = []
                    for a, b in zip(start[head].tolist(), far[np.append(head[1:], len(v)) - 1].tolist(), strict=True):
                        parts.append(x[upto:a])
                        removed, n, upto = removed + b - a, n + 1, b
                    parts.append(x[upto:])
                    kept = b"".join(parts)
                out.append((len(x), removed, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[: 4 + with_text]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return _keyed(docs).join(spans, "row", "left").select("doc_id", "z", "spans").mapInArrow(run, schema)


ORACLE = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS lead FROM w GROUP BY s),
f AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS p FROM w JOIN m USING (s) WHERE m.lead < w.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
t AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS pb FROM r),
c AS (SELECT doc_id, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
