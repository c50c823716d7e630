"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed, each stage on what the one before kept.

All stages take nulls in any column, texts of any length, repeated rows and ids, columns of any other name, and empty tables (which stay empty). All but the last keep all columns of the rows that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import written
from tidewatch.llm.exact_dedup import keep_first
from tidewatch.llm.mixing import mix
from tidewatch.llm.near_dedup import keep_one
from tidewatch.llm.packing import pack
from tidewatch.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go. Null texts are scored as empty; rows that repeat are judged alike; a score of exactly one half stays."""
    return keep_good(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the one with the least doc_id stays. Null texts are empty ones, null ids come last, and of rows that repeat an id and a text one stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of near-duplicates the one with the least doc_id stays. Texts without words are like nothing and stay; null ids come last; of rows that repeat an id and a text one stays."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are drawn so that sources, languages and topics have their shares. Nulls are of no named share; rows with one id are drawn together."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of the documents and their places in sequences. Null and empty texts are one end token; rows that repeat are packed each."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]
#: Trained weights and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
