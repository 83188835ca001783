"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the
shared folder and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import langid, packing, quality, secret_scan, simhash
from shardloom.llm.common import marked, materialize, release_since


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told goes on; those without a letter or an uncertain one go."""
    return langid.keep_identified(docs)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.keep_good(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.keep_representatives(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; a null text stays null, repeated rows are cleaned each."""
    return secret_scan.remove_secrets(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their slots in sequences; a null or empty text is one piece with the end id, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", _language),
    ("quality_rules", _quality),
    ("simhash_near_dedup", _near_duplicates),
    ("secret_scans", _secrets),
    ("best_fit_packing", _packing),
]

#: SQL cannot express language identification; the tests hold `run` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = marked()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
            # What the stage wrote besides, and the stage before it, is needed no more.
            release_since(start)
    return docs
