"""A training-data pipeline over the documents table: each stage calls one operator of fluorite.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage as Parquet in the shared
folder and reads it again as the next one's documents. All but the last return the columns of documents.

Defined cases: null, empty and letterless texts go in the first stage; rows with null or equal ids are told apart by their
texts; extra columns travel along; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.llm import decontamination, language, ngram_join, packing, pseudonyms
from fluorite.llm.common import stored
from fluorite.llm.queries import KEY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or near no language prototype, go; without labelled documents only the former."""
    return language.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, one with the smallest id; unlike rows with equal or null ids are different components."""
    return ngram_join.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window like a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its personal numbers, dates and addresses replaced; n_chars follows the text, unless that is null."""
    out = pseudonyms.pseudonymise(docs, KEY, report=None)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pseudonyms", pseudonymise_values),
    ("packing", pack_sequences),
]

#: Tokenizers, models and component search are beyond SQL; tests/llm/test_contracts.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
