"""A corpus from documents: language ID, near-dedup, mixing to target weights, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, langid, minhash, mixing
from arbora.llm.common import durable, ship, table

#: Share of the tokens that mixing leaves, whatever rare sources or languages there are.
KEPT = 0.65


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known by their text: those without a letter, or far from all languages, go.

    Each row is judged by itself, whether its id is null or repeated.
    """
    ship(spark)
    return langid.known(docs, F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id (rows without id last).

    Rows are told apart by a key of their own, so texts that share an id, or have none, are each compared and kept.
    """
    ship(spark)
    rows = durable(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct("*").alias("_row")))
    ids = rows.select("_key", F.col("_row.doc_id").alias("_id"))
    classes = minhash.near_duplicates(rows.select("_key", F.col("_row.text").alias("text")), "_key").select("_key", "class_id")
    first = classes.join(ids, "_key").groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).alias("_first"))
    return rows.join(first.select("_first._key"), "_key", "left_semi").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that KEPT of the tokens are left, in the raked mix of sources, languages and topics as far as these have them."""
    ship(spark)
    return mixing.mix(docs, keep=KEPT).where("_kept").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("mixing", mix), ("byte-level BPE", encode)]

#: Classification, near-dedup and merging are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
