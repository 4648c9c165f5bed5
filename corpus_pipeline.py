"""A corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it back as the next stage's docs.
All stages but the last keep the columns of ``docs``, whatever they are called.

Null and empty texts: the quality classifier rejects them (no words, no
perplexity), so later stages see none of them unless they are run on their own;
then they stay, are mixed in with size 0, and have no ids.  Null doc_ids and
repeated ones are rows of their own that go by (doc_id, text).  Rows that repeat
both are one document: the near-dedup keeps one of them.  Ties go to the
smaller doc_id, then the smaller hash of the text.  Texts of any length are
treated whole.  An empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telequay.llm.bpe import encode_documents
from telequay.llm.minhash import without_near_duplicates
from telequay.llm.mixing import mixed_rows
from telequay.llm.quality import keep_good
from telequay.llm.queries import table
from telequay.llm.shared import written
from telequay.llm.substrings import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that stood before; n_chars, where there is one, follows the text."""
    out = deduplicate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's row as many times as the mix takes it."""
    return mixed_rows(docs, table(spark, sf_dir, "labels"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of every row's encoding."""
    return encode_documents(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mixing),
    ("bpe encoding", bpe),
]

#: No stage but the mixing can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
