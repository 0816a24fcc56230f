"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are a text's five-word shingles; words are hashed once, and all that follows reads the hashes.  Under one hash function, the passages whose least hash
sits at one and the same token form a compact window (l, c, r): all [i, j] with l <= i <= c <= j <= r.
These windows are nodes of the Cartesian tree of the hashes.  Each of six functions has a tree of
its own, and each window wide enough for a shortest passage is one row: signature (the function
and the token's hash), document, range of starts of shortest passages, place of the token.

1. Rows of one signature meet in one bucket.  In a group of few rows each faces every row of a
   lesser document.  In a crowded one, a row whose whole window is a copy faces the least document
   that has it, and the others go on with their tokens (2).
2. Windows of a crowded signature are put into classes in which any two have similar passages, and
   face the least document of each class: an equal passage; an equal run so long that passages
   around it are similar; a passage that is equal but for one word that is changed, put in or left
   out.  Similar passages in line with each other are in one class at least, so the work is linear
   and no link is lost: of two documents that don't face each other, both face the least of a class.
   This holds if similar passages can't differ by more than one word within; for parameters by which they
   can, no group counts as crowded.  Passages that say three words in a row twice, or two within five,
   may be similar as sets and in no class; those are joined with all others of their signature as
   sets, by their rarest tokens, and each similar pair that no class has linked faces each other.
3. Of two documents, facing windows are joined as intervals: a window counts if one of another
   function overlaps it in both documents, or if its class says enough by itself.  Two passages of
   Jaccard similarity J agree in at least two of the six functions with probability 0.998 at
   J = 0.8.  What lies at the same distance is merged to one candidate.
4. The candidates' tokens are fetched from both texts and verified: each passage of the shortest
   length counts if the Jaccard similarity of the two token sets is high enough, and so does a
   candidate as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, released, written
from .packed import Blob, packed

MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A seed for each hash function.
SEEDS = np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) * MIX | np.uint64(1)
#: Functions that must agree.
ENOUGH = 2
#: Rows of one signature that all face each other; more are crowded.
CROWD = 32
#: In place of a function's number: the two windows are of one class.
CLASS = 7
#: Bytes of a word's hash in the table of words.
WORD_BYTES = 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


#: Bytes that part words.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: What a byte adds to its word's hash; A-Z as a-z.
LETTERS = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) * SEEDS[0] + SEEDS[1])


def word_hashes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """A hash of WORD_BYTES bytes of each word of the texts, one after another, and where each text's words end."""
    raw = np.frombuffer(b"".join([b" ", *[part for t in texts for part in (t, b" ")]]), np.uint8)
    space = SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    found = _mixed(_range_hashes(LETTERS[raw], edges[::2], edges[1::2])) >> np.uint64(64 - 8 * WORD_BYTES)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes(), np.searchsorted(edges[::2], ends)


def read_words(words: bytes) -> np.ndarray:
    """The hashes that word_hashes has given, as integers."""
    out = np.zeros((len(words) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(words, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").reshape(-1)


def token_hashes(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """A 64-bit hash of each shingle of hashed words; as many as words, of which the last shingle - 1 mean nothing."""
    own = _mixed((words + np.uint64(1)) * MIX)
    out = own.copy()
    for j in range(1, shingle):
        out *= MIX
        out[: max(0, len(own) - j)] += own[j:]
    return _mixed(out)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row; the tail is not cut and means nothing."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.concatenate([np.minimum(v[:-step], v[step:]), v[-step:]])
        have += step
    return v


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """Of each of distinct positive values, the place of the last smaller value before it, or -1.

    Between a place and what it points to, all values are greater; so where that one is greater
    too, it is followed to what it points to itself.
    """
    to, open_, with_end = np.arange(-1, len(v) - 1), np.arange(len(v)), np.append(v, np.zeros(1, v.dtype))
    while len(open_ := open_[with_end[to[open_]] > v[open_]]):
        to[open_] = to[to[open_]]
    return to


def _tree_windows(values: np.ndarray, least: int, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes that are at least ``least`` wide; values are distinct and positive.

    values are those of several texts one after another, starts the places where a run of
    ``least`` values lies in one text; low and high are, for each start, its text's first and last
    place.  A node that is wide enough is the minimum of some such run, and so are the smaller
    values next to its window; so the tree is built over these minima alone.
    """
    smallest = _sliding_min(values, least)[starts]
    at = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1])[: len(smallest)])
    v = smallest[at]
    # A minimum of a text's runs leaves and never comes back, so each stands here once.
    places = np.searchsorted(starts, starts[at])
    c = (v & _low_bits(values)).astype(np.int64) - 1
    before, after = _smaller_before(v), len(v) - 1 - _smaller_before(v[::-1])[::-1]
    first = np.where(before >= 0, c[before] + 1, 0)
    last = np.where(after < len(v), np.append(c, 0)[np.minimum(after, len(v))] - 1, len(values) - 1)
    return np.maximum(first, low[places]), c, np.minimum(last, high[places])


def _low_bits(v: np.ndarray) -> np.uint64:
    """A mask for the bits that a place in v takes."""
    return np.uint64((1 << max(1, len(v).bit_length())) - 1)


def distinct_values(hashes: np.ndarray) -> np.ndarray:
    """The hashes with their place, from 1, in the low bits: the leftmost of equals is the least."""
    return (hashes & ~_low_bits(hashes)) | np.arange(1, len(hashes) + 1, dtype=np.uint64)


def cartesian_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The compact windows (l, c, r) of one text at least ``least`` wide, ends included, leftmost first among equals."""
    n = len(values)
    if n < least:
        return []
    starts = np.arange(n - least + 1)
    found = _tree_windows(distinct_values(values.astype(np.uint64) << np.uint64(n.bit_length())), least, starts, np.zeros(len(starts), np.int64), np.full(len(starts), n - 1))
    return [tuple(map(int, x)) for x in zip(*found, strict=True)]


def window_rows(tokens: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, token's place, signature, content) of the compact windows of all functions.

    starts are the places where a passage of ``width`` tokens may begin, ascending, low and high
    their texts' first and last tokens.  The content is a hash of all tokens of the window and of the token's place in it.
    A signature's last three bits are the function's number.
    """
    found = []
    for k, seed in enumerate(SEEDS):
        first, c, last = _tree_windows(distinct_values(_mixed(tokens * seed)), width, starts, low, high)
        a, b = np.maximum(first, c - width + 1), np.minimum(c, last - width + 1)
        found.append((a, b, c, (_mixed(tokens[c] * seed) & ~np.uint64(7)) | np.uint64(k)))
    a, b, c, sign = (np.concatenate(x) for x in zip(*found, strict=True))
    shape = ((c - a) << 8 | (b - a)).astype(np.uint64)
    return a, b, c, sign, _mixed(_range_hashes(tokens, a, b + width) + shape * MIX) >> np.uint64(24)


def _batches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """doc_ids and texts or words of a batch's rows, a bounded number of bytes at a time."""
    ids, held, size = [], [], 0
    for doc_id, x in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
        ids.append(doc_id.as_py())
        held.append(x.as_py())
        size += len(held[-1])
        if size >= most:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def _hashed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, chars, words: the hashed words of each text that has ``words`` or more, written once; all else reads these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _batches(batch, 1 << 19):
                found, ends = word_hashes(texts)
                rows = [(i, len(t), found[a * WORD_BYTES : b * WORD_BYTES]) for i, t, a, b in zip(ids, texts, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True) if b - a >= words]
                ids, sizes, parts = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "chars", "words"])
            del batch
            released()

    with arrow_rows(docs.sparkSession, 500):
        return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chars bigint, words binary"), "passage-words")


def _heads(*keys: np.ndarray) -> np.ndarray:
    """For each row, the first row of its keys; rows are sorted by keys."""
    n = len(keys[0])
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])][:n]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _range_hashes(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of tokens[start:end] for each range, by sums of the tokens times powers of an odd number."""
    base = int(MIX) | 1
    up, down = (np.full(len(tokens) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * np.multiply.accumulate(up)[:-1], out=sums[1:])
    return (sums[end] - sums[start]) * np.multiply.accumulate(down)[start]


#: Starts a to a + more of doc_id face starts from a + shift on; the leader's window has starts la to la + lmore.
FACING = ["doc_id", "leader", "shift", "a", "la", "more"]
FACING_SCHEMA = ", ".join(f"{c} bigint" for c in FACING)


def _facing(doc: np.ndarray, at: np.ndarray, function: np.ndarray | int, ours: np.ndarray, theirs: np.ndarray) -> pa.RecordBatch:
    """Rows of FACING for windows ours of documents that face windows theirs; more packs more, lmore and the function, or CLASS.

    at packs a window's first start, the number of further starts and the token's place.
    """
    s, more, p = at[ours] >> 16, (at[ours] >> 8) & 255, at[ours] & 255
    ls, lmore, lp = at[theirs] >> 16, (at[theirs] >> 8) & 255, at[theirs] & 255
    # Starts relative to the shared token: windows that have some in common face each other by that
    # token; else the end of one faces the beginning of the other.
    low, high = np.maximum(-p, -lp), np.minimum(more - p, lmore - lp)
    apart = np.where(low <= high, 0, np.where(more - p < -lp, low - high, high - low))
    cols = (doc[ours], doc[theirs], ls + lp - s - p + apart, s, ls, (more << 16) | (lmore << 8) | function)
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in cols], FACING)


def _functions(sign: np.ndarray) -> np.ndarray:
    return (sign & np.uint64(7)).astype(np.int64)


def _packed_rows(ids: list[int], texts: list[bytes], words: int, shingle: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) rows of a batch of documents; a negative bucket's blob has rows that face the least copy of their window already."""
    width = words - shingle + 1
    sizes = np.array([len(t) // WORD_BYTES for t in texts])
    begin, counts = np.cumsum(sizes) - sizes, sizes - words + 1
    tokens = token_hashes(read_words(b"".join(texts)), shingle)
    text = np.repeat(np.arange(len(ids)), counts)
    starts = np.arange(len(text)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
    a, b, c, sign, content = window_rows(tokens, starts, begin[text], (begin + sizes - shingle)[text], width)
    which = text[np.searchsorted(starts, a)]
    ids = np.array(ids, np.int64)
    doc = ids[which]
    at = ((a - begin[which]) << 16) | ((b - a) << 8) | (c - a)
    mixed = sign ^ (content << np.uint64(3))
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    same = mixed[1:] == mixed[:-1]
    often = np.append(same, False) | np.append(False, same)
    more = order[often]  # the few that come more than once
    more = more[np.lexsort((at[more], doc[more], content[more], sign[more]))]
    lead = more[_heads(sign[more], content[more])] if len(more) else more
    led = doc[more] != doc[lead]
    if led.any():
        rows = _facing(doc, at, CLASS, more[led], lead[led])
        yield -1 - int(abs(int(ids[0])) % buckets), packed(*[np.asarray(v).view(np.uint64) for v in rows.columns])
    rest = np.concatenate([order[~often], more[~led]])
    bucket = (sign >> np.uint64(3)) % np.uint64(buckets)
    rest = rest[np.lexsort((sign[rest], bucket[rest]))]
    edges = np.flatnonzero(np.append(True, bucket[rest][1:] != bucket[rest][:-1])[: len(rest)])
    for x, y in zip(edges, np.append(edges[1:], len(rest)), strict=True):
        i = rest[x:y]
        used, number = np.unique(which[i], return_inverse=True)
        yield int(bucket[i[0]]), packed(ids[used].view(np.uint64), np.diff(sign[i], prepend=np.uint64(0)), number, at[i] >> 16, (at[i] >> 8) & 255, at[i] & 255, content[i])


def _met(blobs: list[bytes], crowd: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket that face each other; where more than ``crowd`` rows have a signature, windows that are no copies come as _crowded takes them."""
    parts = []
    for x in map(Blob, blobs):
        at = (x[3] << np.uint64(16)) | (x[4] << np.uint64(8)) | x[5]
        parts.append((np.cumsum(x[1], dtype=np.uint64), x[0].view(np.int64)[x[2].astype(np.int64)], at.view(np.int64), x[6]))
    sign, doc, at, content = (np.concatenate(v) for v in zip(*parts, strict=True))
    del parts
    order = np.argsort(sign, kind="stable")
    same = sign[order[1:]] == sign[order[:-1]]
    order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((at[order], doc[order], sign[order]))]
    sign, doc, at, content = (v[order] for v in (sign, doc, at, content))
    if not len(sign):
        return
    head = _heads(sign)
    size = np.bincount(head, minlength=len(sign))[head]
    several = np.bincount(head, doc != doc[head], len(sign))[head] > 0
    few = several & (size <= crowd) if crowd else several
    left, step = np.flatnonzero(few), 1
    while len(left := left[left - step >= head[left]]):
        ours = left[doc[left] != doc[left - step]]
        for k in range(0, len(ours), 100_000):
            i = ours[k : k + 100_000]
            yield _facing(doc, at, _functions(sign[i]), i, i - step)
        step += 1
    many = np.flatnonzero(several & ~few)
    many = many[np.lexsort((many, content[many], sign[many]))]
    lead = many[_heads(sign[many], content[many])] if len(many) else many
    copies = doc[many] != doc[lead]
    for k in range(0, int(copies.sum()), 100_000):
        yield _facing(doc, at, CLASS, many[copies][k : k + 100_000], lead[copies][k : k + 100_000])
    rest = many[~copies]
    for k in range(0, len(rest), 100_000):
        i = rest[k : k + 100_000]
        cols = [doc[i], np.zeros(len(i), np.int64), sign[i].view(np.int64), at[i] >> 16, at[i] & 255, (at[i] >> 8) & 255]
        yield pa.RecordBatch.from_arrays([pa.array(v, mask=np.full(len(i), c == "leader")) for c, v in zip(FACING, cols, strict=True)], FACING)


def _rolling(v: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Hashes of v[0:size], v[1:size + 1] and so on, for each row."""
    base = int(MIX) | 1
    away, base = np.uint64(pow(base, size, 1 << 64)), np.uint64(base)
    h = np.zeros_like(v[0])
    for j, x in enumerate(v):
        h = h * base + x
        if j >= size:
            h = h - v[j - size] * away
        if j >= size - 1:
            yield h


def _said_again(v: np.ndarray, most: int) -> np.ndarray:
    """For each line and column of v, the last line before that has the same value, if no more than ``most`` lines away, or -1; values have 54 bits, 0 means nothing."""
    before = np.full(v.shape, -1, np.int16)
    key = np.sort(np.ascontiguousarray(v.T) << np.uint64(10) | np.arange(len(v), dtype=np.uint64), axis=1)
    high = key >> np.uint64(10)
    column, at = np.nonzero((high[:, 1:] == high[:, :-1]) & (high[:, 1:] > 0))
    line, last = (key[column, x] & np.uint64(1023) for x in (at + 1, at))
    near = line - last <= most
    before[line[near], column[near]] = last[near]
    return before


def _repeating(words: np.ndarray, width: int, shingle: int) -> np.ndarray:
    """By place and row, whether a passage that starts there says three words in a row twice, or two within ``shingle`` words.

    words has a line for each place as _class_pairs says; 0 where a row has no word.
    """
    hashed = lambda v, known: np.where(known, (_mixed(v * MIX) >> np.uint64(11)) + np.uint64(1), np.uint64(0))
    two = hashed(words[1:] << np.uint64(8 * WORD_BYTES + 1) | words[:-1], (words[1:] > 0) & (words[:-1] > 0))
    three = hashed(two[1:] * MIX + words[:-2], (two[1:] > 0) & (words[:-2] > 0))
    out = np.zeros((width, words.shape[1]), bool)
    for v, more, most in ((two, 2, shingle), (three, 3, width + shingle)):
        again = _said_again(v, most)
        some = np.flatnonzero((again >= 0).any(axis=0))
        last = -_sliding_min(-again[:, some], width + shingle - 1 - more)  # but the passage's first run
        out[:, some] |= last[1 : width + 1] >= np.arange(width)[:, None]
    return out


def _repeating_pairs(group: np.ndarray, doc: np.ndarray, tokens: np.ndarray, again: np.ndarray, alone: np.ndarray, odd: np.ndarray, runs: np.ndarray, similarity: float, gapped: bool) -> Iterator[np.ndarray]:
    """Pairs (row, row, the greater first) of windows with passages in line that are similar as sets, of which one is ``odd``.

    A join of sets by their rarest tokens: of two similar ones, each has a token among those that
    the other may not lack.  alone and odd tell by place and row which passages are no copies and which ones
    repeat; runs has for each place and row the class of the run there, less than 0 where a class
    doesn't say that any two of it are similar.  What a class has linked is left out.
    """
    (width, n), core = alone.shape, len(tokens) + 1 - len(runs)
    lost, none = width - core, np.iinfo(np.int32).max
    asked = alone & odd

    def similar(j: int, rows: np.ndarray, rank: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Pairs of rows, of those that the codes stand for, that no class links and that are similar."""
        x, y = code // len(rows), code % len(rows)
        a, b = rows[x], rows[y]
        fine = np.ones(len(x), bool)
        for k in range(j, j + lost + 1):
            fine &= (runs[k, a] != runs[k, b]) | (runs[k, a] < 0)
        x, y = x[fine], y[fine]
        if gapped and len(x):
            # Where all that differs is one stretch, the two are of a class of one word changed.
            off = tokens[j : j + width, rows[x]] != tokens[j : j + width, rows[y]]
            kept = (size[x] < width - 1) | (width - off.argmax(axis=0) - off[::-1].argmax(axis=0) > lost)
            x, y = x[kept], y[kept]
        both = np.sort(np.concatenate([rank[:, x], rank[:, y]]), axis=0)
        shared = ((both[1:] == both[:-1]) & (both[1:] < none)).sum(axis=0)
        fine = shared >= similarity * (size[x] + size[y] - shared) - 1e-9
        return rows[x[fine]] * n + rows[y[fine]]

    for j in range(width):
        rows = np.flatnonzero(alone[j])
        rows = rows[np.isin(group[rows], group[asked[j]])]
        if len(rows) < 2:
            continue
        single = again[j : j + width, rows] < j
        key = tokens[j : j + width, rows] ^ (group[rows] >> np.uint64(32) << np.uint64(32))
        _, number, count = np.unique(key[single], return_inverse=True, return_counts=True)
        place = np.empty(len(count), np.int32)
        place[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
        rank = np.full(key.shape, none, np.int32)
        rank[single] = place[number]
        rank.sort(axis=0)
        size = (rank < none).sum(axis=0)
        few = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
        q, x = np.nonzero(np.arange(width)[:, None] < few)
        token, wanted = rank[q, x], asked[j, rows]
        o = np.lexsort((x, token))
        token, x = token[o], x[o]
        head, held, many = _heads(token), [], 0
        left, step = np.arange(len(token)), 1
        while len(left := left[left - step >= head[left]]):
            a, b = x[left], x[left - step]
            fine = (wanted[a] | wanted[b]) & (doc[rows[a]] != doc[rows[b]])
            fine &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
            held.append(a[fine] * len(rows) + b[fine])
            many += len(held[-1])
            if many >= 200_000:
                held, many = [np.unique(np.concatenate(held))], 0
                for k in range(0, len(held[0]), 50_000):
                    yield similar(j, rows, rank, size, held[0][k : k + 50_000])
                held = []
            step += 1
        if held:
            code = np.unique(np.concatenate(held))
            for k in range(0, len(code), 50_000):
                yield similar(j, rows, rank, size, code[k : k + 50_000])


def _class_pairs(sign: np.ndarray, doc: np.ndarray, at: np.ndarray, words: np.ndarray, width: int, shingle: int, similarity: float, lost: int) -> np.ndarray:
    """Pairs (row, row) of windows of which the second is the first one's least of a class, or else like it where a passage repeats words.

    Rows are sorted by sign and doc.  words has a line for each place from width - 1 before the
    shared token to width + shingle - 2 after it, and in it each row's hashed word there plus one, or 0.
    The tokens made of them are two bytes of a hash.
    """

    def hashed(words: np.ndarray) -> np.ndarray:
        own = _mixed(words * MIX)
        out = own[: 2 * width - 1].copy()
        for j in range(1, shingle):
            out = out * MIX + own[j : j + 2 * width - 1]
        return _mixed(out) >> np.uint64(32)

    tokens = hashed(words).astype(np.uint16)
    n, core = len(sign), width - lost
    low = width - 1 - (at & 255)
    starts_end = low + ((at >> 8) & 255) + 1  # past the last start
    v = [_mixed((x.astype(np.uint64) + np.uint64(1)) * MIX) for x in tokens]
    group, pairs = _mixed(sign), []

    def classes(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The least row of each row's class."""
        order = np.argsort(key, kind="stable")
        out = np.empty_like(rows)
        out[order] = rows[order[_heads(key[order])]]
        return out

    def paired(rows: np.ndarray, lead: np.ndarray, seen: np.ndarray) -> None:
        new = (doc[rows] != doc[lead]) & (seen[rows] != lead)
        seen[rows] = lead
        pairs.append(rows[new] * n + lead[new])

    seen, runs = np.full(n, -1), np.full((2 * width - core, n), -1, np.int32)
    for j, h in enumerate(_rolling(v, core)):
        rows = np.flatnonzero((low <= j) & (j + core < starts_end + width))
        if len(rows):
            runs[j, rows] = lead = classes(rows, _mixed(h[rows] ^ group[rows]))
            paired(rows, lead, seen)
    seen, alone = np.full(n, -1), []
    for j, h in enumerate(_rolling(v, width)):
        rows = np.flatnonzero((low <= j) & (j < starts_end))
        if len(rows):
            lead = classes(rows, _mixed(h[rows] ^ group[rows]))
            paired(rows, lead, seen)
            own = rows[lead == rows]
            alone.append((np.full(len(own), j, np.int64), own))
    if alone:
        place, own = (np.concatenate(x) for x in zip(*alone, strict=True))
        single = np.zeros((width, n), bool)
        single[place, own] = True
        some = np.flatnonzero(single.any(axis=0))
        odd = _repeating(words[:, some], width, shingle)
        kept = np.isin(group[some], group[some[(odd & single[:, some]).any(axis=0)]])
        some, odd = some[kept], odd[:, kept]
        whole = hashed(words[:, some])
        again, runs = _said_again(whole + np.uint64(1), width - 1), runs[:, some]
        for j, run in enumerate(runs):
            # Two passages around a run of so many tokens are similar whatever else they have.
            most = core - np.count_nonzero(again[j : j + core] >= j, axis=0)
            run[most < similarity * (most + 2 * lost) - 1e-9] = -1
        for code in _repeating_pairs(group[some], doc[some], whole, again, single[:, some], odd, runs, similarity, lost == shingle):
            pairs.append(some[code // len(some)] * n + some[code % len(some)])
        del single, odd, whole, again
    del runs
    # One word within changes shingle tokens, or shingle - 1 where it is left out, or one less where a word comes again.
    if lost == shingle and alone:
        half = (core + 1) // 2
        part = np.stack([h >> np.uint64(32) for h in _rolling(v, half)]).astype(np.uint32)
        for first in (True, False):
            found = []
            for gap in (shingle, shingle - 1, shingle - 2):
                end = place + core + gap
                big = part[place if first else end - half, own].astype(np.uint64)
                found.append(_mixed(((big << np.uint64(16)) | tokens[end - 1 if first else place, own]) * MIX ^ group[own]))
            key = np.concatenate(found)
            order = np.argsort(key, kind="stable")
            head = _heads(key[order])
            order_doc = doc[own[order % len(own)]]
            other = np.bincount(head, order_doc != order_doc[head], len(order))[head] > 0
            order, head = order[other], head[other]
            edges = np.flatnonzero(np.append(True, head[1:] != head[:-1])[: len(head)])
            at_most, k = 1 << 14, 0
            while k < len(order):
                stop = edges[min(np.searchsorted(edges, k + at_most), len(edges) - 1)] if len(edges) else len(order)
                stop = int(stop) if stop > k else len(order)
                i = order[k:stop] % len(own)
                gaps = shingle - order[k:stop] // len(own)
                i, gaps = i[o := np.argsort(own[i], kind="stable")], gaps[o]
                rows, begin = own[i], place[i]
                sums = [np.zeros(len(i), np.uint64)]
                base = np.uint64(int(MIX) | 1)
                for t in range(width):
                    sums.append(sums[-1] * base + _mixed((tokens[begin + t, rows].astype(np.uint64) + np.uint64(1)) * MIX))
                sums, line = np.stack(sums), np.arange(len(i))
                for m in range(half, core) if first else range(1, core - half + 1):
                    power = np.uint64(pow(int(base), core - m, 1 << 64))
                    right = sums[core + gaps, line] - sums[m + gaps, line] * power
                    lead = classes(rows, _mixed(_mixed(sums[m]) * MIX ^ _mixed(right) ^ group[rows]))
                    apart = doc[rows] != doc[lead]
                    pairs.append(np.unique(rows[apart] * n + lead[apart]))
                k = stop
    code = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return np.stack([code // max(1, n), code % max(1, n)])


def _crowded(rows: DataFrame, hashed: DataFrame, words: int, shingle: int, similarity: float, lost: int) -> DataFrame:
    """Rows of FACING for the rows without leader that _met gives."""
    width = words - shingle + 1
    part = F.call_function("substring", F.col("words"), (F.col("a") * WORD_BYTES + 1).cast("int"), ((F.col("more") + words) * WORD_BYTES).cast("int"))
    own = rows.select("doc_id", F.col("shift").alias("sign"), "a", F.col("la").alias("p"), "more")
    filled = own.join(hashed.select("doc_id", "words"), "doc_id").select("sign", "doc_id", "a", "p", "more", part.alias("part")).distinct()

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, doc, a, p, more = (np.concatenate([_columns(b.select([i]))[0] for b in held]) for i in range(5))
        held_words = np.zeros((2 * width + shingle - 2, len(sign)), np.uint64)
        i = 0
        for b in held:
            for k in range(0, b.num_rows, 10_000):
                parts = [x.as_py() for x in b.column(5).slice(k, 10_000)]
                sizes = np.array([len(x) // WORD_BYTES for x in parts])
                row = np.repeat(np.arange(i, i + len(parts)), sizes)
                held_words[np.arange(len(row)) + np.repeat(width - 1 - p[i : i + len(parts)] - np.cumsum(sizes) + sizes, sizes), row] = read_words(b"".join(parts)) + np.uint64(1)
                i += len(parts)
        at = (a << 16) | (more << 8) | p
        ours, theirs = _class_pairs(sign.view(np.uint64), doc, at, held_words, width, shingle, similarity, lost)
        for k in range(0, len(ours), 100_000):
            yield _facing(doc, at, CLASS, ours[k : k + 100_000], theirs[k : k + 100_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # of the last signature more may come
        for batch in batches:
            sign = _columns(batch.select([0]))[0]
            if not len(sign):
                continue
            if size >= 20_000:
                now = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                upto = int(np.argmax(np.append(sign != now, True)))
                if upto < len(sign):
                    yield from judged([*held, batch.slice(0, upto)])
                    held, size, batch = [], 0, batch.slice(upto)
                    released()
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from judged(held)
        del held
        released()

    return filled.repartition("sign").sortWithinPartitions("sign", "doc_id", "a").mapInArrow(run, FACING_SCHEMA)


def _faced(hashed: DataFrame, words: int, shingle: int, similarity: float, bucket_chars: int, crowd: int) -> DataFrame:
    """Rows of FACING for all documents; the number of buckets follows from the size of all texts."""
    width = words - shingle + 1
    # Tokens that a passage may have and a similar one lack, if none comes twice.
    lost = width - int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    crowd = crowd if lost <= shingle else None
    total = hashed.agg(F.sum("chars")).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_chars)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _batches(batch, 1 << 20):
                sent = list(_packed_rows(ids, texts, words, shingle, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.binary())], ["bucket", "blob"])
            ids = texts = sent = None
            released()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    x = Blob(blob.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)) for i in range(len(FACING))], FACING)
                    continue
                if bucket != now and blobs:
                    yield from _met(blobs, crowd)
                    blobs = []
                    released()
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from _met(blobs, crowd)
        released()

    sent = hashed.select("doc_id", "words").mapInArrow(send, "bucket bigint, blob binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FACING_SCHEMA)
    if not crowd:
        return met
    with arrow_rows(hashed.sparkSession, 1000):
        met = written(met, "passage-windows")
    return met.where("leader is not null").union(_crowded(met.where("leader is null"), hashed, words, shingle, similarity, lost))


def overlapping(pair: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, function: np.ndarray, enough: int) -> np.ndarray:
    """Which windows [a, b] that face [la, lb] overlap, on both sides, those of ``enough`` functions, their own included, or are of one class.

    An interval join: rows are sorted by pair and a, and each is compared with the rows after it
    for as long as these begin before its end.
    """
    seen = np.where(function == CLASS, 3 << 8, 1 << function)
    left, step = np.arange(len(pair)), 1
    while True:
        left = left[left < len(pair) - step]
        left = left[(pair[left] == pair[left + step]) & (a[left + step] <= b[left])]
        if not len(left):
            return np.bitwise_count(seen) >= enough
        i = left[(la[left] <= lb[left + step]) & (la[left + step] <= lb[left])]
        seen[i] |= 1 << function[i + step]
        seen[i + step] |= 1 << function[i]
        step += 1


def _candidates(met: DataFrame, gap: int) -> DataFrame:
    """doc_id, leader, shift, a, b: where windows of enough functions overlap, merged where no more than ``gap`` starts lie between."""
    names = ["doc_id", "leader", "shift", "a", "b"]

    def judged(v: np.ndarray) -> pa.RecordBatch:
        doc, leader, shift, a, la, more = v.T
        b, lb = a + (more >> 16), la + ((more >> 8) & 255)
        pair = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (leader[1:] != leader[:-1]))[: len(doc)])
        fine = np.flatnonzero(overlapping(pair, a, b, la, lb, more & 7, ENOUGH))
        fine = fine[np.lexsort((a[fine], shift[fine], pair[fine]))]
        doc, leader, shift, a, b, pair = (x[fine] for x in (doc, leader, shift, a, b, pair))
        # Within a pair and shift, b grows as a does but for windows of one start.
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > b[:-1] + gap))[: len(fine)])
        last = np.maximum.reduceat(b, first) if len(first) else b
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (doc[first], leader[first], shift[first], a[first], last)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # of the last pair more may come
        for batch in batches:
            v = np.stack(_columns(batch), axis=1)
            if not len(v):
                continue
            if held and (v[-1, :2] == held[0][0, :2]).all():
                held.append(v)
                continue
            v = np.concatenate([*held, v])
            upto = int(np.argmax((v[:, :2] == v[-1, :2]).all(axis=1)))
            held = [v[upto:]]
            yield judged(v[:upto])
        if held:
            yield judged(np.concatenate(held))
        del held
        released()

    placed = met.repartition("doc_id", "leader").sortWithinPartitions("doc_id", "leader", "a")
    return placed.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _tokens(parts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Four bytes of each token's hash of the words of each part, one part after another, and how many tokens each has."""
    sizes = np.array([len(x) // WORD_BYTES for x in parts], np.int64)
    counts = np.maximum(0, sizes - shingle + 1)
    whole = token_hashes(read_words(b"".join(parts)), shingle).astype(np.uint32)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return whole[place < np.repeat(counts, sizes)], counts


def similar_windows(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place, similar) of every window of ``width`` tokens of many pairs of texts at once.

    x and y hold the pairs' tokens one after another, ``sizes`` of each.  A window is similar if
    the sets x[place : place + width] and y[place : place + width] are.  Tokens that agree place
    by place give a lower bound, tokens that the other text has at all an upper one; the sets
    themselves are compared only between the two, and only where no similar window covers the
    place yet.
    """
    n, counts = len(sizes), np.maximum(sizes - width + 1, 0)
    begin = np.cumsum(sizes) - sizes
    pair = np.repeat(np.arange(n), counts)
    at = np.arange(len(pair)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
    total = lambda v: np.concatenate([[0], np.cumsum(v)])
    inside = lambda t: t[at + width] - t[at]
    m = inside(total(x == y))
    enough = 2 * width * similarity - 1e-9
    fine = m * (1 + similarity) >= enough
    of = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), sizes)
    xs, ys = of | x, of | y
    repeats = np.zeros(n, bool)  # with repeats inside, the bounds don't hold
    for v in (np.sort(xs), np.sort(ys)):
        repeats[(v[1:][v[1:] == v[:-1]] >> np.uint64(32)).astype(np.int64)] = True
    fine = np.where(repeats[pair], m == width, fine)
    if fine.all():
        return pair, at, fine
    maybe = ~fine & (repeats[pair] | (inside(total(np.isin(xs, ys))) * (1 + similarity) >= enough))
    step = np.bincount(at[fine], minlength=len(x) + 1) - np.bincount(at[fine] + width, minlength=len(x) + 1)
    maybe &= inside(total(np.cumsum(step)[:-1] > 0)) < width
    distinct = lambda v: 1 + (v[:, 1:] != v[:, :-1]).sum(axis=1)
    left = np.flatnonzero(maybe)
    for k in range(0, len(left), 1 << 14):
        i = left[k : k + (1 << 14)]
        own, theirs = (v[at[i][:, None] + np.arange(width)] for v in (x, y))
        p, q, either = (distinct(np.sort(v, axis=1)) for v in (own, theirs, np.concatenate([own, theirs], axis=1)))
        fine[i] = p + q - either >= similarity * either - 1e-9
    return pair, at, fine


def whole_similar(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of texts as similar_windows takes them, whether their whole token sets are similar."""
    of = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes)
    p, q = np.unique(of | x), np.unique(of | y)
    count = lambda v: np.bincount((v >> np.uint64(32)).astype(np.int64), minlength=len(sizes))
    both = count(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (count(p) + count(q) - both) - 1e-9


def _verified(found: DataFrame, hashed: DataFrame, words: int, shingle: int, similarity: float) -> DataFrame:
    """doc_id, leader, start, end (in words; end is past the last).

    A candidate counts as a whole if it is similar as a whole, however its shorter passages fare.
    """
    width, key = words - shingle + 1, ["doc_id", "leader", "shift", "a", "b"]
    side = lambda name, at: found.select(F.col(name).alias("of"), *key, F.lit(name).alias("side"), at.alias("at"))
    asked = side("doc_id", F.col("a")).union(side("leader", F.col("a") + F.col("shift")))
    size = (F.col("b") - F.col("a") + words) * WORD_BYTES
    own = hashed.select(F.col("doc_id").alias("of"), "words")
    parts = asked.join(own, "of").select(*key, "side", F.call_function("substring", F.col("words"), (F.greatest("at", F.lit(0)) * WORD_BYTES + 1).cast("int"), F.greatest(size + F.least("at", F.lit(0)) * WORD_BYTES, F.lit(0)).cast("int")).alias("part"))
    # Not a join of the two sides, for which all words would be read and dealt out twice.
    sides = [F.max(F.when(F.col("side") == name, F.col("part"))).alias(c) for name, c in (("doc_id", "x"), ("leader", "y"))]
    both = parts.groupBy(*key).agg(*sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[tuple]) -> pa.RecordBatch:
            doc, leader, shift, a = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            x, sizes = _tokens([r[4] for r in rows], shingle)
            theirs, counts = _tokens([r[5] for r in rows], shingle)
            begin = np.cumsum(sizes) - sizes
            y = ~x  # outside the leader's text nothing is equal
            before = np.maximum(0, -(a + shift))
            kept = np.minimum(counts, np.maximum(0, sizes - before))
            line = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
            y[line + np.repeat(begin + before, kept)] = theirs[line + np.repeat(np.cumsum(counts) - counts, kept)]
            pair, place, fine = similar_windows(x, y, sizes, width, similarity)
            fine |= whole_similar(x, y, sizes, similarity)[pair]
            start = a[pair] + place - begin[pair]
            p, s = pair[fine], start[fine]
            head = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] > s[:-1] + words)][: len(p)])
            last = s[np.append(head[1:], len(s))[: len(head)] - 1]
            cols = [doc[p[head]], leader[p[head]], s[head], last + words]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["doc_id", "leader", "start", "end"])

        for batch in batches:
            held, size = [], 0
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                held.append(row)
                size += len(row[4])
                if size >= 1 << 20:
                    yield judged(held)
                    held, size = [], 0
            if held:
                yield judged(held)
            del held
            released()

    return both.select("doc_id", "leader", "shift", "a", "x", "y").mapInArrow(run, "doc_id bigint, leader bigint, start bigint, end bigint")


def near_passages(docs: DataFrame, text: str = "text", words: int = 50, shingle: int = 5, similarity: float = 0.8, bucket_chars: int = 8 << 20, crowd: int = CROWD) -> DataFrame:
    """doc_id, leader, start, end: words start to end - 1 of doc_id make up passages that repeat in leader, whose id is less.

    docs needs doc_id and text; words are white-space separated, A-Z in lower case.  Texts of
    fewer than ``words`` words, null texts and rows without doc_id have no passages.  Repeated
    rows of a doc_id are one document and don't repeat each other; a doc_id that stands for
    several texts has no passages, since none could be told apart.  An empty table gives an empty
    result; other columns are not read.  Signatures of up to ``crowd`` windows link every two
    documents with similar passages; beyond, documents are linked to the least one of each class
    of similar passages, so that n copies make n - 1 links and not n squared.
    """
    if not shingle < words < 250 + shingle:
        raise ValueError("words must lie between shingle and 250 + shingle")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    text_hash = F.xxhash64("text")
    several = written(docs.groupBy("doc_id").agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b")).where("a <> b").select("doc_id"), "passage-doubtful")
    if not several.isEmpty():
        docs = docs.join(several, "doc_id", "left_anti")
    hashed = _hashed(docs, words)
    found = written(_candidates(_faced(hashed, words, shingle, similarity, bucket_chars, crowd), 3 * words), "passage-candidates")
    return _verified(found, hashed, words, shingle, similarity).where("leader < doc_id").distinct()


def _union_length(runs):
    step = lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["upto"], x["start"]), F.lit(0))).alias("n"))
    return F.aggregate(runs, F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n")), step)["n"]


def passage_links(docs: DataFrame, **options) -> DataFrame:
    """One row for two documents that share passages: doc_id, leader, n_passages, n_words, spans."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    links = near_passages(docs, **options).groupBy("doc_id", "leader").agg(spans.alias("spans"))
    return links.select("doc_id", "leader", F.size("spans").cast("bigint").alias("n_passages"), _union_length(F.col("spans")).alias("n_words"), "spans")


def without_passages(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the words of repeated passages taken out of all but the leaders' texts.

    A passage goes with the white space after it.  All columns and rows are kept, in place of a
    text what is left of it; a row without a repeated passage keeps its text as it is.
    """
    spans = near_passages(docs, text, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out, kinds = list(docs.columns), dict(docs.dtypes)
    place, free = out.index(text), "_" + max(out, key=len)  # a name that no column has
    left = docs.join(spans.select(F.col("doc_id").alias(free), F.col("spans").alias(free + "s")), F.col("doc_id") == F.col(free), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts = []
            for x, runs in zip(batch.column(place).to_pylist(), batch.column(len(out)).to_pylist(), strict=True):
                if runs and x is not None:
                    at = [m.start() for m in WORD.finditer(x)] + [len(x)]
                    kept, upto = [], 0
                    for r in runs:
                        s, e = at[min(r["start"], len(at) - 1)], at[min(r["end"], len(at) - 1)]
                        if s > upto:
                            kept.append(x[upto:s])
                        upto = max(upto, e)
                    kept.append(x[upto:])
                    x = "".join(kept)
                texts.append(x)
            cols = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays(cols, out)

    return left.select(*[F.col(f"`{c}`") for c in out], free + "s").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out))
