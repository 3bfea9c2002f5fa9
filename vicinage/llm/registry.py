"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import chat, hamming, jaccard, mixing, pieces, quality, runs, sharding, spans, tokencount, tokenfile, toxicity, variants
from vicinage.llm.common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.token_digests(spark, path)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), "text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(rows))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows, rows.where(F.col("id") % 50 == 0)).withColumnRenamed("id", "vec_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), variants.MISSPELT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_format": op7_chat_format,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_hamming_top_k": op9_hamming_top_k,
    "op10_mixing": op10_mixing,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

_MARKS = "(length(t) - length(regexp_replace(t, '[<\\[\\\\]', '', 'g')))"
_ROLE_MARKS = _MARKS.replace("(t", "(r")

ORACLES: dict[str, str] = {
    # a raw text misleads the parser if it holds its own form's end mark or a code of the escapes
    "op7_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        marked AS (
            SELECT *, {_MARKS} AS marks, {_ROLE_MARKS} AS role_marks,
                contains(t, CASE r WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '<</ROLE>>' END) OR regexp_matches(t, '\\\\[slb]') AS misleads
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
            CAST(3 + sum(length(t) + CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 25 + length(r) + role_marks END + CASE WHEN misleads THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op9_hamming_top_k": """
        WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
        d AS (
            SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] > 0) <> (embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM q, embeddings
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
    """,
}
