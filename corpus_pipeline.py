"""Five stages from raw documents to token files: quality rules, near-dedup, decontamination, mixing, token-ID output.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
Any stage works on an empty table, on nulls in any column, on repeated rows (judged alike) and keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablekit.llm.minhash import one_of_each
from tablekit.llm.mixing import mixed_documents
from tablekit.llm.quality import passing
from tablekit.llm.suffixes import decontaminated
from tablekit.llm.token_files import token_output
from tablekit.llm.work import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a similarity of 0.8 or more."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to one and a half times as often."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet matrix files of the ids, read back: doc_id, start, n_tokens, ids_crc32 per row of the mixture."""
    return token_output(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token output", token_ids)]

#: Robust estimates, confirmed shingle links and token ids have no counterpart in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
