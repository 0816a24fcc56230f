"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it kept, and
returns a DataFrame; run() writes each stage's result to the shared folder and reads it back as
the next one's input.  All stages but the last return the columns of documents.  An empty table
passes through all stages as an empty table.  Verdicts hold for the rows that they were made of,
told apart by doc_id (null is a value) and a hash of what was judged: of several rows with one
doc_id, or without any, each fares by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import compact_windows, decontaminate, prefix_encoder, quality_rules, registry, simhash
from blockloom.llm.common import table, written


def _keyed(docs: DataFrame, *cols: str | Column) -> tuple[DataFrame, str]:
    """docs with a hash of cols in a column whose name no other has."""
    name = "_" + max(docs.columns, key=len)
    return docs.withColumn(name, F.xxhash64(*cols)), name


def _without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and key are among rejected's doc_id and row_key; without the key's column."""
    a, b = docs.alias("a"), rejected.select("doc_id", "row_key").distinct().alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{key}") == F.col("b.row_key"))
    return a.join(b, same, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the adaptive quality rules reject; a null or empty text is one."""
    keyed, key = _keyed(docs, "text", "lang", "source")
    return _without(keyed, key, quality_rules.quality_rules(keyed, key=key).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash component its least document, whole.

    Rows that are equal in doc_id and text are one document.  Rows without doc_id lead no group;
    they go if a document with one is in theirs, and stay if none is.
    """
    keyed, key = _keyed(docs, "text")
    groups = simhash.simhash_components(keyed, key=key)
    return _without(keyed, key, groups.where("component_id is not null and not doc_id <=> component_id"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts of all documents but the leading ones; n_chars follows.

    Rows without doc_id and doc_ids that stand for several texts keep their texts.
    """
    left = compact_windows.without_passages(docs)
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


#: A window of this many words of one benchmark item is a leak by itself.
WINDOW = 8


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a whole window of a benchmark item, or two items of any length.

    An item of fewer words than a window may well stand in a clean text by chance, so one such
    item alone is no leak.
    """
    keyed, key = _keyed(docs, F.coalesce("text", F.lit("")))
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), size=WINDOW)
    leaks = F.col("contaminated") | F.exists("spans", lambda x: x["end"] - x["start"] >= WINDOW)
    return _without(keyed, key, found.where(leaks).withColumnRenamed("text_hash", "row_key"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left, and decodes it again; a null text is empty, and every row has its own result."""
    return prefix_encoder.encode_documents(docs, registry.tokenizer_file("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("passages", passages),
    ("decontaminate", decontaminated),
    ("sentencepiece", encoded),
]

#: SQL has neither this SimHash nor this encoding; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
