"""The corpus pipeline: a chain of stages over `documents`, each written as Parquet and read again.

Languages are identified and texts without a known one go; of near duplicates one stays; secrets are taken
out of the texts; the sources are mixed to their weights, with copies; what remains is encoded.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, langid, minhash, mixing, secret_scan
from foliant.llm.common import drop_folder, shared_dir

LEAST_SCORE, OVER_EVEN = 0.35, 1.4  # of a language: the first, or so many times even odds where these are less, as with more than four


def least_score(langs: int) -> float:
    """The least score of a language that is known, among so many."""
    return min(LEAST_SCORE, OVER_EVEN / max(langs, 1))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known. The network learns from the labelled rows of docs.

    Texts that are null, empty or without letters have none and go, as does every text where no row is labelled.
    Repeated rows are judged each; further columns are kept; an empty table gives no rows.
    """
    net = langid.train(docs)
    return langid.keep_identified(docs, net, least_score(len(net.langs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links at 0.8 on shingles of five words.

    30 bands of four values: a pair at 0.8 shares none with a probability under 10 ** -6. Rows without an id or
    without words stay; rows that share an id stay or go together; further columns are kept; an empty table gives no rows.
    """
    return minhash.keep_one(docs, width=5, percent=80, hashes=60)


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, whose lengths follow; no document goes. Null texts stay null; further columns are kept."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have the words of their targets.

    Null texts have no words, and a source without words is left out; a null source is one; repeated rows are
    documents each; rows keep all their columns, whatever these are called or hold; an empty table gives no rows.
    """
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document; a null text has no tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", take_out_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL expresses neither the network nor the merges; tests hold each stage against a plainer form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder. A stage's rows are removed when the next are written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
