"""The queries opN_<name>, the pipeline and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: A conversation that says what templates of other models take for control strings.
ODD_TURN = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_of_documents

    return media_of_documents(table(spark, sf_dir, "documents"))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], turns.schema)
    return read_chats(format_chats(turns.unionByName(odd)))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import score_documents

    return score_documents(table(spark, sf_dir, "documents"), vocabulary_path=public_tokenizers.path("piece_bpe_32k.model"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), vocabulary_a=public_tokenizers.path("byte_bpe_50k.json"),
                           vocabulary_b=public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


ORACLES = {
    "op10_source_mixing": r"""
WITH labelled AS (
  SELECT doc_id, CASE WHEN min(coalesce(quality, 0)) = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(l.weight, 0.5::DOUBLE) AS weight
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM by_source),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM capped),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce(w * max(CASE WHEN here < cap / w THEN here END) OVER (), cap)) AS target FROM levels),
keyed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         -ln((('0x' || substr(md5(concat('0|', coalesce(s.doc_id::VARCHAR, ''), '|', s.size::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE) / s.weight AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM keyed)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       source, (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM summed""",
}
