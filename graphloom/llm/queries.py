"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, chat_format, fingerprint, lang_id, lm_scoring, near_dedup, packing, quality_rules, suffix_dedup, token_files
from .common import documents

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _fold(column: str, folds: int):
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % folds


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_conversations(turns.unionByName(more)))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2)
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int")))
    sketches = {"text": "sketch", "next_text": "next_sketch", "edited": "edited_sketch"}  # after the exchange: they are larger than the texts
    rows = fingerprint.with_next(docs, "text").withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[fingerprint.sketch(F.col(c)).alias(s) for c, s in sketches.items()])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_string(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)))
    profiles = lang_id.fit_profiles(docs.where("not held_out"))
    return lang_id.predict_languages(docs, profiles, "held_out")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir), _fold("doc_id", 7) == 2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end=0))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    ids = bpe_automaton.encode_documents(documents(spark, sf_dir), path)
    return bpe_automaton.decode_documents(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = quality_rules.judge_quality(documents(spark, sf_dir), labels, F.col("lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_format, op2_fingerprint, op3_near_dedup, op4_suffix_dedup, op5_lang_id, op6_lm_scoring, op7_token_files, op8_bpe, op9_packing, op10_quality_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None of these digests is plain SQL on whole tables: each query is tested against brute force."""
    return {}
