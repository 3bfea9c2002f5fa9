"""A corpus pipeline of five stages: toxicity, near-duplicates, repeated passages, mixing, pieces.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet in the
shared folder and read again as the next one's docs, so that a lost executor costs one stage's tasks; the
files of a stage go when the next one is written, the last ones stay for the reader of the result.

All stages take rows with a null doc_id, text or source, rows that repeat an id or both id and text, very long texts,
extra columns of any name, and empty tables (which give empty results). What each of them does with such rows
stands in its function here and in its operator's module.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vicinage.llm.common import remove, shared_dir
from vicinage.llm.jaccard import keep_one
from vicinage.llm.mixing import mixed_rows
from vicinage.llm.pieces import encode_pieces
from vicinage.llm.spans import dedup_spans
from vicinage.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; null and empty texts score as texts without a hit, and stay."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the least id, null last. Texts without words all stay, as do rows of one id whose texts are not linked."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that a repeated span covers; no row goes, and null texts stay null."""
    return dedup_spans(docs).select(*(f"`{c}`" for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice; texts without words are not taken, a null source is one of its own."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best piece segmentations of every row, checked by decoding; null text counts as empty."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

#: SQL can express neither the scores nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
