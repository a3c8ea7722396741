"""The corpus pipeline: documents in, token ids out, one operator to a stage.

Every stage gets what its predecessor kept, read again from Parquet. All stages but the last
return the columns of ``documents``. Part of the training-data operators (``affinis.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.langid import UNKNOWN, train_languages, with_languages
from affinis.llm.mixing import mixed_documents
from affinis.llm.pieces import piece_codes
from affinis.llm.queries import vocabulary
from affinis.llm.simhash import simhash_kept
from affinis.llm.texts import read, whole
from affinis.llm.toxicity import train_toxicity, with_toxicity
from affinis.workspace import written

TOXIC_FROM = 0.3
LANGUAGE_FROM = 0.4  # below it no language is more than a guess


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored below the threshold; learned from the labels of the same folder."""
    model = train_toxicity(docs, read(spark, sf_dir, "labels"), "doc_id", "text")
    scored = with_toxicity(whole(docs), "_whole.text", model, ["_whole"], TOXIC_FROM)
    return scored.where(F.col("predicted") == 0).select("_whole.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    model = train_languages(docs, "doc_id", "text", "lang")
    named = with_languages(whole(docs), "_whole.text", model, ["_whole"])
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LANGUAGE_FROM)).select("_whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash_kept(docs, "doc_id", "text", words=3, max_bits=2)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time that it takes them."""
    return mixed_documents(docs, "doc_id", "text", "source")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``ids`` and the digests of ids and decoded text."""
    coded = piece_codes(docs, "text", vocabulary("piece_bpe_32k.model"), ["doc_id", "source"])
    return coded.drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

# Trained models and exact tokenizers cannot be written in SQL; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
