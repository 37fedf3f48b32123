"""A corpus in five stages: language, near duplicates, secrets, mixture, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents; each stage's rows are written and read again as the next one's input. Rows with
nulls in any column, repeated rows and extra columns pass through the stages unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagloom.llm import count_rtree, kneser_ney, mixing, packing, secrets
from bagloom.llm.common import Tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those they reject (null, no letters, unlike all languages) go."""
    return kneser_ney.accepted(docs, kneser_ney.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, likeness of 0.8 or more)."""
    return count_rtree.one_of_each(docs, size=5, num=4, den=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mark and n_chars of the new text."""
    return secrets.redacted(docs, secrets.train(docs.select("doc_id", "text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("without_secrets", without_secrets), ("mixture", mixture), ("packed", packed)]

#: SQL expresses none of the models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
