"""Token-id files: documents' ids, compressed one by one with a shared zstandard dictionary.

A data set of token files is a folder of Parquet whose rows are shards, so that Spark's commit
protocol covers lost executors and repeated tasks, and any store that Spark writes will do.  A
shard holds the bytes

    b"TOKZ" | version u16 | id width u16 | documents u64 | SHA-256 of the dictionary
    | doc_id i64[n] | offset u64[n + 1] | ids u64[n] | zstandard frames

all little-endian; offsets count from the first frame, and each document's ids are one frame, so
a short document is read with the index and one small frame.  Shards are in ascending order of
doc_id: first by part, then by number.  The dictionary is trained on the serialised ids of a
bounded sample of documents and lies in a folder of its own beside the shards.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

MAGIC, VERSION = b"TOKZ", 1
#: Characters on which this module's pre-token pattern and the library's agree for certain.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
SPACED = re.compile(f" [{LETTERS}]+")
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^ \\t\\n\\r{LETTERS}{DIGITS}]+|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+")


class ByteBpe:
    """A byte-level BPE of the tokenizers library, with a bounded cache of pre-tokens.

    The library encodes every distinct pre-token once and everything else whole: texts with
    added tokens' strings, and texts with characters on which patterns might disagree.
    """

    def __init__(self, file: str, cache_size: int = 800_000):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not made.get("normalizer") and not made.get("post_processor")
        self.added = [x["content"] for x in made.get("added_tokens") or ()]
        self.dtype, self.code = ("<u2", "H") if self.tok.get_vocab_size() <= 65536 else ("<u4", "I")
        pieces = self.tok.get_vocab()
        self.spaced = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.spaced[[i for x, i in pieces.items() if x.startswith("\u0120")]] = True  # how byte-level pieces write a space
        self.size, self.cache, self.old, self.chars = cache_size, {}, {}, 0

    def _bytes(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, pretokens: set[str]) -> None:
        """Puts the pre-tokens into the cache; what isn't asked for any more goes in the end."""
        new = pretokens.difference(self.cache)
        if len(self.cache) + len(new) > self.size or self.chars > 20 * self.size:
            self.old, self.cache, self.chars, new = self.cache, {}, 0, pretokens
        self.chars += sum(map(len, new))
        kept = [x for x in new if x in self.old] if self.old else []
        self.cache.update((x, self.old[x]) for x in kept)
        new = new.difference(kept)
        words = list(filter(SPACED.fullmatch, new))
        for at in range(0, len(words), 4096):
            self._learn_words(words[at : at + 4096])
        new = list(new.difference(words))
        self.cache.update((x, self._bytes(e.ids)) for x, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Words that each begin with a space, in one text: the library splits them there, and the tokens that begin with a space tell where."""
        ids = self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids
        raw, first = self._bytes(ids), np.flatnonzero(self.spaced[ids])
        if len(first) != len(words):
            raise ValueError("the tokenizer doesn't split words at spaces")
        at, width = 0, np.dtype(self.dtype).itemsize
        for x, end in zip(words, np.append(first[1:], len(ids)).tolist(), strict=True):
            self.cache[x] = raw[at : end * width]
            at = end * width

    def encode_batch(self, texts: list[str], at_once: int = 1 << 19) -> list[bytes]:
        """The ids of each text in the width of dtype; at most about ``at_once`` characters are in work."""
        out, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= at_once or i == len(texts) - 1:
                out += self._encode(held)
                held, size = [], 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        apart = [self.split and PLAIN.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        whole = iter(self.tok.encode_batch([t for t, ok in zip(texts, apart, strict=True) if not ok], add_special_tokens=False))
        parts = [PRETOKEN.findall(t) if ok else None for t, ok in zip(texts, apart, strict=True)]
        self._learn(set().union(*[p for p in parts if p]))
        ids = self.cache.__getitem__
        return [b"".join(map(ids, p)) if p is not None else self._bytes(next(whole).ids) for p in parts]


_BPE: dict[str, ByteBpe] = {}


def bpe_for(file: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    if file not in _BPE:
        _BPE[file] = ByteBpe(file)
    return _BPE[file]


def pack(rows: list[tuple[int, int, bytes]], width: int, dictionary_sha: bytes) -> bytes:
    """A shard of (doc_id, number of ids, frame) rows."""
    sizes = np.array([0] + [len(r[2]) for r in rows], "<u8").cumsum().astype("<u8")
    head = MAGIC + np.array([VERSION, width], "<u2").tobytes() + np.array([len(rows)], "<u8").tobytes() + dictionary_sha
    return b"".join([head, np.array([r[0] for r in rows], "<i8").tobytes(), sizes.tobytes(), np.array([r[1] for r in rows], "<u8").tobytes(), *[r[2] for r in rows]])


class Shard:
    """Reads a shard's index; ids(i) decompresses one document and nothing else."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        version, self.width = np.frombuffer(blob, "<u2", 2, 4)
        self.n = int(np.frombuffer(blob, "<u8", 1, 8)[0])
        if blob[:4] != MAGIC or version != VERSION or blob[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this version and dictionary")
        self.doc_ids = np.frombuffer(blob, "<i8", self.n, 48)
        self.offsets = np.frombuffer(blob, "<u8", self.n + 1, 48 + 8 * self.n)
        self.counts = np.frombuffer(blob, "<u8", self.n, 56 + 16 * self.n)
        self.blob, self.at = blob, 56 + 24 * self.n
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.at + int(self.offsets[i]), self.at + int(self.offsets[i + 1])
        raw = self.unpack.decompress(self.blob[a:b], max_output_size=int(self.counts[i] * self.width))
        return np.frombuffer(raw, f"<u{self.width}")


@dataclass(frozen=True)
class TokenFiles:
    """Where a data set lies: shards (part, shard, n_ids, bytes) and the one row of its dictionary."""

    path: str

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, shard int, n_ids bigint, bytes binary").parquet(f"{self.path}/shards")

    def dictionary(self, spark: SparkSession) -> bytes:
        return bytes(spark.read.schema("sha256 string, bytes binary").parquet(f"{self.path}/dictionary").first()["bytes"])


def train_dictionary(docs: DataFrame, file: str, sample: int = 1000, most_ids: int = 20_000, size: int = 65_536) -> bytes:
    """A dictionary from ``sample`` documents, those least by hash; of each at most ``most_ids`` ids are looked at.

    Empty if the sample is too small to train on.
    """
    import zstandard

    first = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.join(F.broadcast(first.distinct()), "doc_id", "left_semi").select(F.substring("text", 1, 8 * most_ids).alias("text")).limit(2 * sample)
    bpe = bpe_for(file)
    samples = [x[: most_ids * np.dtype(bpe.dtype).itemsize] for x in bpe.encode_batch([r["text"] for r in few.collect()])]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 20)), [x for x in samples if len(x) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return b""


def part_bounds(docs: DataFrame, parts: int, coarse: int = 2000) -> list[float]:
    """Ascending doc_ids that divide docs into about ``parts`` ranges of like size; what they are equal to lies above.

    Up to ``coarse`` bounds come from one quantile summary. Beyond that, each of its ranges has a
    summary of its own, made by a distributed aggregate, so no summary grows with the table.
    """
    n = min(parts, coarse)
    first = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if parts <= coarse:
        return first

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(first, np.float64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy().astype(np.float64), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0)], ["range", "doc_id"])

    each = -(-parts // (len(first) + 1))
    inner = F.percentile_approx("doc_id", [i / each for i in range(1, each)] or [0.5], 4 * each)
    found = docs.select("doc_id").mapInArrow(placed, "range int, doc_id bigint").groupBy("range").agg(inner.alias("bounds")).toArrow()  # a number for each part
    return sorted({*first, *map(float, found.column("bounds").combine_chunks().values.to_pylist())})


def write_token_files(docs: DataFrame, file: str, path: str | None = None, end_id: int | None = 0, text: str = "text", docs_a_part: int = 4000, coarse: int = 2000, shard_bytes: int = 4 << 20, level: int = 1) -> TokenFiles:
    """Encodes docs (doc_id, text) and writes them as a data set in ascending doc_id order.

    A null text counts as empty.  Rows without doc_id can't be addressed and are left out.
    Repeated doc_ids are documents of their own, next to each other, in the order of their ids'
    bytes.  An empty table gives a data set without shards.  Other columns are not read.  Only
    compressed frames are shuffled, once; the parts' bounds come from quantile summaries of the
    doc_id column, and their number grows with the table, so a part doesn't.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, file)
    sha = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(sha.hex(), bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    bounds = part_bounds(docs, max(1, -(-docs.count() // docs_a_part)), coarse)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, edges = bpe_for(file), np.array(bounds, np.float64)
        end = np.array([end_id], bpe.dtype).tobytes() if end_id is not None else b""
        width = np.dtype(bpe.dtype).itemsize
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = [x + end for x in bpe.encode_batch(part.column(1).to_pylist())]
                place = np.searchsorted(edges, part.column(0).to_numpy().astype(np.float64), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), part.column(0), pa.array([len(x) // width for x in raw], pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())], ["part", "doc_id", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, now, number, held, size = np.dtype(bpe_for(file).dtype).itemsize, None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(r[1] for r in held)], pa.int64()), pa.array([pack(held, width, sha)], pa.binary())], ["part", "shard", "n_ids", "bytes"])

        for batch in batches:
            for part, doc_id, n, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (part != now or size >= shard_bytes):
                    yield out()
                    number, held, size = number + 1 if part == now else 0, [], 0
                elif part != now:
                    number = 0
                now = part
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield out()

    frames = docs.mapInArrow(encode, "part int, doc_id bigint, n bigint, frame binary")
    placed = frames.repartition("part").sortWithinPartitions("part", "doc_id", "n", "frame")
    placed.mapInArrow(shards, "part int, shard int, n_ids bigint, bytes binary").write.parquet(f"{path}/shards")
    return TokenFiles(path)


def read_index(files: TokenFiles, spark: SparkSession) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as u32)."""
    dictionary = files.dictionary(spark)
    shards = files.shards(spark)
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    # One row of two numbers for each part, that is, for each few thousand documents.
    before_part = by_part.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("before_part"))
    sizes = shards.select("part", "shard", "n_ids")
    before = sizes.join(before_part, "part").select("part", "shard", (F.col("before_part") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(blob, dictionary)
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(shard.n)]
                counts = shard.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * shard.n, pa.int32()), pa.array([number] * shard.n, pa.int32()), pa.array(shard.doc_ids), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    read = shards.select("part", "shard", "bytes").mapInArrow(run, "part int, shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
