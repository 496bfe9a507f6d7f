"""Corpus preparation: documents to encoded text, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its output is written as Parquet and read again as the next one's
input. All stages but the last return the columns of documents.

Defined results: texts that are null, empty or without letters go in the first
stage, whatever their other columns; null ids and sources are kept, and a null
lang is filled in. Rows that repeat id and text are one document from the second
stage on, of which one stays; different texts of one id are documents of their
own; rows without an id stay, as nothing tells them apart. Of a group of near
copies the first by id stays, then by text. The fourth stage returns documents
cut at the borders of blocks, as often as the mix takes them, so ids repeat
after it. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.jaccard import keep_one_of_each
from lodestrata.llm.langid import keep_known_languages
from lodestrata.llm.mixing import mixed_documents
from lodestrata.llm.scratch import delete, shared_root
from lodestrata.llm.secrets import redact_secrets
from lodestrata.llm.tokens import encode_pieces


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one learned language holds half of the letters by words it knows."""
    return keep_known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    return keep_one_of_each(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secret values replaced by a mark."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources to their target weights takes: the parts of documents in each block drawn."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of the text read back."""
    return encode_pieces(docs, path=public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True).drop("decoded")


STAGES = [(f.__name__, f) for f in (languages, near_copies, secrets, mixing, encoding)]

#: Learned models and encodings cannot be written in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next begins; what a
    stage read is deleted when it is written."""
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
            if i:
                delete(spark, f"{root}/{STAGES[i - 1][0]}")
    return docs
