"""Corpus preparation in stages; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import langid, mixing, pii
from folioscope.llm.bpecodec import encode_decode
from folioscope.llm.minhash import near_duplicates
from folioscope.operators.components import shared_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: far from every language, or without letters.

    A kept document without a language gets the predicted one.  Where no document has a
    language, only those without letters go.
    """
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    return found.where(~F.col("rejected")).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity of 0.8.

    Documents without an id take no part and stay.  Rows that share id and text are one
    document, of which the least by its other columns stays; rows that share an id but not
    the text stay or go together.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id")
    own = docs.select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = own.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    return once.select("doc_id", "text", *(F.col(f"rest.{c}").alias(c) for c in rest)).select(*COLUMNS).union(own.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the names of its kinds; no document goes."""
    redacted = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    length = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", length).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Raises small sources by temperature, up to twice their size; every document stays."""
    return mixing.mix(docs.select(*COLUMNS), mixing.word_count(F.col("text")), max_repeats=2.0).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every remaining document, and the text that they decode to."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("minhash_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("source_mixing", mixed),
    ("bpe_encode", encoded),
]

#: Fitted models, similarity links and merges of word pieces have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    folder = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
