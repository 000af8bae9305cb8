"""A corpus pipeline: language, quality, near copies, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), docs being what the stage
before kept, with the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import lang_id, near_dedup, packing, quality_rules, suffix_dedup
from graphloom.llm.common import documents, dropped, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is in none of the languages where its rank-order likeness to the nearest is lower than this
#: quantile of the labelled rows' own, less a margin: short clean texts score lower than the rows do.
LANGUAGE_QUANTILE, LANGUAGE_MARGIN = 0.01, 0.2
#: The cutoff of languages with fewer labelled rows than such a quantile needs, and that number.
MIN_LANGUAGE_SCORE, LEAST_LABELLED = 0.3, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no known language: those without letters, and those far from every profile."""
    profiles = lang_id.fit_profiles(docs)
    judged = lang_id.predict_languages(docs, profiles, *COLUMNS[1:])
    # with nothing to learn from, only texts without letters can be told
    if not profiles.langs:
        return judged.where(F.regexp_like("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    least = F.lit(MIN_LANGUAGE_SCORE)
    for lang, cutoff in lang_id.fit_cutoffs(docs, profiles, LANGUAGE_QUANTILE, LANGUAGE_MARGIN, LEAST_LABELLED).items():
        least = F.when(F.col("lang_pred") == lang, cutoff).otherwise(least)
    known = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= least)
    return judged.where(known).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a certified cutoff of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    metrics = quality_rules.quality_metrics(docs, F.col("lang"))
    cutoffs = quality_rules.fit_cutoffs(metrics, labels)
    kept = quality_rules.with_metrics(docs.select(*COLUMNS), F.col("lang"))
    return quality_rules.with_verdict(kept, cutoffs).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least doc_id."""
    return near_dedup.near_dedup(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that repeat; all documents stay."""
    cut = suffix_dedup.without_repeats(docs.select(*COLUMNS), keep=COLUMNS[2:4])
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for each piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, forget=True)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("sequences", sequences),
]

#: Tokens, digests and signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage has
    read goes when its result is written."""
    docs, read = documents(spark, sf_dir), None
    for name, stage in STAGES:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            dropped(read)
        docs = read = kept
    return docs
