"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every run of eight words of a benchmark item is a window (an item of fewer words is one window).
A document contains a window only if it contains the window's rarest word, the one prefix token
that full containment needs; rarity is counted over all documents.  Windows meet documents on
that word alone, are dropped where the word stands too near an end of the document for the
window to fit around it or the next rarest word isn't in its place (the length and position
bounds), and the rest are verified word by word.

The windows are broadcast in slices of a checked size, by hash, however many share a prefix word: a benchmark
that outgrows the bound costs further passes over the documents, not memory.  Documents are
never shuffled by word, so neither a common word nor a passage in a third of all documents loads
a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before and after A-Z are lower-cased.
#: The ASCII characters one by one: Java looks these up in a table, and ranges one after another.
RAW_WORD = f"[0123456789{UPPER}{LOWER}" + r"\x{80}-\x{10FFFF}]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words in their own case: only what is compared in the end has to be lower-cased."""
    return F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))


def _lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, size: int, item_text: str = "text") -> DataFrame:
    """(words, size, item_id): the distinct windows of each item, lower-cased, as arrays of words."""
    words = F.regexp_extract_all(_lower(F.col(item_text).cast("string")), F.lit(WORD), F.lit(0))
    has = items.where(F.col("item_id").isNotNull()).select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return has.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()


def with_prefix(docs: DataFrame, wins: DataFrame, text: str) -> DataFrame:
    """wins with their two rarest words (key and key2, in lower case of any script), these words' places and the window as one string."""
    each = wins.select("words", F.explode("words").alias("word")).select(F.lower("word").alias("key")).distinct()
    found = docs.select(F.explode(_words(F.col(text))).alias("word")).select(F.lower("word").alias("key")).join(_sliced(each), "key", "left_semi")
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    placed = wins.select("item_id", "words", F.posexplode("words").alias("place", "word")).withColumn("key", F.lower("word"))
    rated = placed.join(counts, "key")
    whole = rated.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("n", "key", "place"))).alias("order"))
    # A word that no document has rules its windows out.
    known = whole.where(F.size("order") == F.size("words"))
    first, second = F.get("order", F.lit(0)), F.get("order", F.least(F.lit(1), F.size("order") - 1))
    return known.select("item_id", first["key"].alias("key"), first["place"].alias("place"), second["key"].alias("key2"), second["place"].alias("place2"), F.size("words").alias("size"), F.concat_ws(" ", "words").alias("window"))


def _sliced(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A broadcast hint for tables of at most ``most`` rows of a word each; Spark chooses for others."""
    return F.broadcast(df) if df.count() <= most else df


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", size: int = 8, least_items: int = 2, slice_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, item_ids and text_hash (xxhash64 of the text, null as empty).

    docs needs doc_id and text, items needs item_id and text; other columns are not read.  spans
    holds the hit words' merged ranges (start, end) by word number from 0.  A null or empty text
    has no words, an item without words no window, and an item without item_id is left out.
    Repeated rows of docs come out as often as they stand there, repeated items count once.  An
    empty benchmark leaves every document clean, an empty table gives an empty result.
    slice_rows bounds what is broadcast at once, in windows of at most ``size`` words.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    items = items.select("item_id", F.col("text"))
    rated = written(with_prefix(docs, windows(items, size), "text"), "benchmark-windows")
    slices = max(1, -(-rated.count() // slice_rows))
    hits = None
    for i in range(slices):
        part = F.broadcast(rated.where(F.pmod(F.xxhash64("key", "window"), F.lit(slices)) == i) if slices > 1 else rated)
        words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("w"))
        each = words.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "word")).withColumn("key", F.lower("word"))
        met = each.join(part, "key").where((F.col("pos") >= F.col("place")) & (F.col("pos") - F.col("place") + F.col("size") <= F.size("w")))
        start = F.col("pos") - F.col("place")
        next_rarest = F.lower(F.get("w", start + F.col("place2"))) == F.col("key2")
        same = met.where(next_rarest & (_lower(F.concat_ws(" ", F.slice("w", start + 1, F.col("size")))) == F.col("window")))
        new = same.select("doc_id", "text_hash", start.alias("start"), (start + F.col("size")).alias("end"), "item_id")
        hits = new if hits is None else hits.union(new)
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"), F.collect_set("item_id").alias("item_ids"))

    def merged(spans: Column, run: Column) -> Column:
        last = F.element_at(spans, -1)
        joins = (F.size(spans) > 0) & (run["start"] <= F.get(spans, F.size(spans) - 1)["end"])
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(spans, F.array(F.struct(run["start"].alias("start"), run["end"].alias("end")))))

    spans = F.aggregate("runs", F.lit([]).cast("array<struct<start:int,end:int>>"), merged)
    found = by_doc.select("doc_id", "text_hash", spans.alias("spans"), "item_ids")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count("text", F.lit(RAW_WORD)).cast("bigint").alias("n_words"))
    a, b = base.alias("a"), found.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0))
    ids = F.coalesce(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    return both.select(
        "a.doc_id",
        "n_words",
        n_hit.cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (F.size(ids) >= least_items).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        ids.alias("item_ids"),
        "a.text_hash",
    )


ORACLE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(g) AS size, array_to_string(g, ' ') AS g FROM (SELECT item_id, w[i:i + 7] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT doc_id, i, p.size, item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM pos, (SELECT DISTINCT size FROM win) WHERE i + size - 1 <= len(w)) p JOIN win ON win.size = p.size AND win.g = p.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""
