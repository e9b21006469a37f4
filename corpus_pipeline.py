"""Documents to token ids: five stages, each of them written as Parquet and read again.

Every stage takes rows as they come: null ids, texts, languages and sources are values like
others, repeated rows are decided together, an empty table stays empty, very long texts
count whole, and columns of other names are carried to the last stage, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import langid, mixing, neardup, pii, piececodec
from tallystone.llm.common import MADE, discard, shared_uri


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known go; the others stay as they are."""
    return langid.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return neardup.kept_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to the name of its kind."""
    return pii.masked_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, begin and end included."""
    return piececodec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"], spans=False)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", source_mix), ("pieces", pieces)]

#: no stage can be said in SQL: trained tables, XXH64, contexts, hash orders and piece models
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage has written besides its result is deleted once that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = len(MADE)
        path = shared_uri(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, before, path)
        docs = spark.read.parquet(path)
    return docs
