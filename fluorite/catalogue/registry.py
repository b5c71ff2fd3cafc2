"""A query and its SQL twin are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import similarity as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


class Tables:
    """Tables of a directory by attribute."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/{name}.parquet")


def fingerprints(t: Tables) -> DataFrame:
    """id, bits, words, n of every document's word fingerprint."""
    texts = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if len(texts.inputFiles()) < cores:  # a table of few files would leave most cores idle
        texts = texts.repartition(cores)
    bits = texts.select("id", B.word_fingerprint(F.col("text")).alias("bits"))
    return bits.select("id", "bits", B.pack(F.col("bits"), 16).alias("words"), F.size("bits").alias("n"))


#: DuckDB: the word fingerprint of every document.
FP = """fp as (select doc_id id, list_sort(list_distinct([('0x'||substr(md5(w),1,3))::int % 1024
 for w in regexp_split_to_array(lower(text),'[ \\n]+') if length(w)>0])) bits from documents)"""
#: DuckDB: pairs (a, b) of documents with c shared bits, by an inverted index.
PAIRS = FP + """, e as (select id, len(bits) n, unnest(bits) bit from fp),
 pairs as (select x.id a, y.id b, x.n na, y.n nb, count(*) c from e x join e y on x.bit=y.bit and x.id<>y.id group by all)"""
