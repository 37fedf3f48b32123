"""The registered queries of the operators: each runs with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagloom.llm import merkle
from bagloom.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(column: str, modulus: int, rest: int) -> F.Column:
    return F.coalesce(crc_mod(column, modulus) == rest, F.lit(False))


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import katz

    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text", (~held("doc_id", 5, 1)).alias("learn")))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_merkle_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import mjpeg

    return mjpeg.digests(table(spark, sf_dir, "documents"))


def op5_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import count_rtree

    return count_rtree.join(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, num=90, den=100, links=True)


def op6_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import kneser_ney

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held("doc_id", 4, 2))
    models = kneser_ney.learn(docs.filter(~F.col("held_out")))
    return kneser_ney.identify(docs, models, ["doc_id", "held_out"])


def op7_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.train(docs))


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import url_trees

    return url_trees.judge(table(spark, sf_dir, "pages"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.llm import suffixes

    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_katz_backoff, op2_pivotal_mix, op3_merkle_fingerprints, op3_merkle_trees, op4_avi_mjpeg, op5_count_rtree, op6_kneser_ney_langid, op7_secret_cnn, op8_url_trees, op9_sum_of_squares, op10_induced_suffixes)}
ORACLE_SQL: dict[str, str] = {"op3_merkle_fingerprints": merkle.ORACLE, "op3_merkle_trees": merkle.TREES}
