"""The corpus pipeline: quality, near-duplicates, secrets, packing, over `documents`.

Each stage takes all rows that the one before it kept. Between stages the rows are Parquet in the shared folder.

Results for odd input: see the operators. A null text is an empty one to every stage and stays null in the rows that the
first three hand on; an empty table goes through all stages; repeated rows are near-duplicates, of which one stays;
further columns are kept by the first three stages, whatever their names, and ignored by the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import packing, quality, secrets, shared, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: groups are linked by 256-bit SimHashes of five-word shingles."""
    return simhash.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; n_chars follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences of 1024."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: Trained scores, fingerprints and tokens can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
