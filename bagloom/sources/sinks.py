"""What becomes of results: files, the driver, a printed table, a named view."""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def save(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Writes parquet, orc, json, csv or text, optionally partitioned by columns."""
    writer = df.write.mode(mode).format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def save_text(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """One line per row, fields separated; nested fields as JSON."""
    from pyspark.sql import functions as F

    plain = [F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(sep, *(F.coalesce(c, F.lit("")) for c in plain)).alias("value")).write.mode(mode).text(path)


def collect(df: DataFrame, limit: int = 1_000_000) -> list[Any]:
    """The rows on the driver; more than limit is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them instead")
    return rows


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def element(df: DataFrame) -> Any | None:
    """Any one row, or None of an empty bag."""
    rows = df.limit(1).collect()
    return rows[0] if rows else None


def view(df: DataFrame, name: str) -> DataFrame:
    """Registers a temporary view for SQL texts."""
    df.createOrReplaceTempView(name)
    return df


def cached(df: DataFrame) -> DataFrame:
    """Kept in memory and on disk for a bag that several results share; lost parts are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
