"""The corpus pipeline: language ID, exact duplicates, near duplicates, secret scans, packing. Each stage reads what the one before has written.

Defined results: stages decide by row, so repeated and null doc_ids never make a row lost or kept in another's place. Null and empty texts have no language:
the first stage rejects them. Of rows with equal texts one stays, that of the largest doc_id (null first); of near duplicates one, that of the smallest (null
last). Extra columns are passed on to the last stage whatever their names, which gives only its own columns. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, language_id, near_dedup, packing, secrets
from pulsegrid.llm.common import materialise, scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    judged = language_id.identify(docs.select(F.struct("*").alias("__doc"), "doc_id", "text", "lang", "source"), keep=["__doc"])
    return judged.where("lang_kept").select("__doc.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.survivors(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words a shingle, similarity 0.8 or more), the document with the smallest doc_id."""
    return near_dedup.survivors(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every live-looking secret's characters replaced by a mark of its kind; n_chars follows the text."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the language model, the tokenizer or the components; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def run_over(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages over docs; a stage's scratch tables go when its result is written."""
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
