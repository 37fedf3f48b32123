"""Tables that cut a loop's lineage, written where driver and executors both read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is set here only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The same rows, read from a table: recomputing them costs a scan, whatever made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy(df: DataFrame) -> bool:
    """Whether reading it again would do more than scan, filter and project files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not df.isStreaming and any(x in plan for x in ("Join", "Aggregate", "Sort", "Window", "Generate", "Repartition", "LogicalRDD"))
