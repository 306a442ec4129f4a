"""The corpus pipeline: documents in, tokenised training mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.

Defined results: rows with a null text are dropped by the first stage (they have
no language); an empty table stays empty; extra columns are carried to the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tidemark.llm.shared import materialise

#: Share of a document's letters that its language must have.
MIN_SCORE = 0.4
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or whose main language has too few of their letters."""
    model = language_id.fit(docs)
    return language_id.keep_identified(docs, model, MIN_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.drop_copies(docs, keep="smallest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return near_dedup.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by source weight, repeated where a source's target is above its size."""
    # Rows are told apart by file and position, as unlike documents may have one id.
    place = F.struct("_metadata.file_path", "_metadata.row_index") if docs.inputFiles() else None
    return mixing.mixed_documents(docs, place, weights=WEIGHTS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of ids and decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), full=True).drop("decoded")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe_encode", encode_stage),
]

#: Models, sampling and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
