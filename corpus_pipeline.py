"""Cleaning of a corpus: language, quality, near duplicates, long repeats, then packing into training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import langid, minhash, packing, quality, recompression
from genoloom.llm.scratch import Scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as ``row`` and what a stage reads, so that a stage's columns meet no others of their names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages: with a letter, and at most MOST_BITS bits a byte in the best.

    Null and empty texts go; a null lang is not learned from, a null doc_id is; repeated rows are judged alike; without a
    labelled row nothing is learned and all go.
    """
    model = langid.train(docs.filter(~langid.in_fold("doc_id", 4, 2)))
    found = langid.predict(apart(docs, "text"), model)
    return found.filter((found["lang_pred"] != langid.UNKNOWN) & (found["bits_per_byte"] <= langid.MOST_BITS)).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the suffix-array rules keep, each row for itself; null and empty texts go."""
    return quality.rules(apart(docs, "text")).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component at five words and a similarity of 0.8, and every row with a null doc_id.

    All rows of the doc_id that stays are kept, if they repeat. Texts without a word, null or empty, link with nothing.
    """
    return minhash.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document with a smaller doc_id has. A text may become empty; n_chars stays that of the source.

    A null text or doc_id stays as it is; rows that repeat a doc_id are each cut at their own places.
    """
    return recompression.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts that are left into sequences of 4096 tokens; a null or empty text has the end token alone, repeated rows are packed each."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
