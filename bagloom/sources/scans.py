"""Scans and in-memory bags.

Text files are read by Spark's own readers with a schema, so that columns and filters are
pruned at the scan; parquet is the format to prefer.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per line."""
    return spark.read.text(path)


def fields(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Separated text with typed columns; a line that doesn't fit gives nulls."""
    return spark.read.csv(path, schema=schema, sep=sep, mode="PERMISSIVE")


def adjacency(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(id, neighbours) of lines `id,n1,n2,...`."""
    parts = F.split("value", sep)
    return lines(spark, path).select(F.get(parts, F.lit(0)).cast("long").alias("id"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("long")).alias("neighbours"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def bag(spark: SparkSession, items: list, schema: Any = None) -> DataFrame:
    """A local list as a bag: `value` for scalars, `_1`, `_2`, ... for tuples. An empty list needs a schema."""
    if schema is not None:
        return spark.createDataFrame(items, schema)
    rows = [x if isinstance(x, tuple) else (x,) for x in items]
    return spark.createDataFrame(rows, [f"_{i + 1}" for i in range(len(rows[0]))] if isinstance(items[0], tuple) else ["value"])


def inclusive_range(spark: SparkSession, low: int, high: int, step: int = 1) -> DataFrame:
    """(value) from low to high, both included."""
    return spark.range(low, high + (1 if step > 0 else -1), step).toDF("value")


def vector(df: DataFrame, order: list[str] | None = None, start: int = 0) -> DataFrame:
    """(i, v) of a bag: positions in a given order, or else in that of the partitions. v is a struct unless there is one column.

    Both ways are distributed: a range-partitioned sort, then one count per partition of the staged rows.
    """
    from bagloom.plans.lower import indexed

    v = F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*df.columns)
    return indexed((df.orderBy(*order) if order else df).select(v.alias("v")), start)


def matrix(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """(i, j, v) in standard types."""
    return df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).alias("v"))


def empty_array(spark: SparkSession, kind: str, item: str) -> DataFrame:
    """An empty vector, matrix or map with cells of a type."""
    keys = {"vector": "i long", "matrix": "i long, j long", "map": "k string"}[kind]
    return spark.createDataFrame([], T.StructType.fromDDL(f"{keys}, v {item}") if hasattr(T.StructType, "fromDDL") else f"{keys}, v {item}")


def known(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table made on the driver, handed over by Arrow: its size is known, so joins broadcast it and not the other side."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)], names=names))
