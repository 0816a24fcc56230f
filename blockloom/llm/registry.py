"""The queries of this subpackage over the input tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, compact_windows, cotraining, decontaminate, prefix_encoder, quality_rules, simhash, suffix_dedup, token_counts, token_files
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take this path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return prefix_encoder.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return cotraining.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(asks)
    chosen = chat.format_trees(chat.as_tree(turns)).withColumnRenamed("tree", "conv_id")
    return chat.digests(chosen, "conv_id")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passage_links(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.read_index(token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json")), spark)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.decontaminate(docs, items).drop("spans", "item_ids", "text_hash")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_cotraining": op3_cotraining,
    "op4_chat": op4_chat,
    "op5_passages": op5_passages,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_chat": chat.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
