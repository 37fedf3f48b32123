"""Why-provenance: which source rows a result comes from, and which come to nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_and_erased(traced: DataFrame, sources: dict[str, DataFrame], text: str) -> DataFrame:
    """(source, row, status) for the sources that the text names."""
    kept = traced.select(F.explode("lineage").alias("x")).select("x.*").distinct().withColumn("__kept", F.lit(True))
    every = None
    for name, df in sources.items():
        if re.search(rf"\b{name}\b", text):
            rows = df.select(F.lit(name).alias("source"), F.to_json(F.struct(*df.columns)).alias("row"))
            every = rows if every is None else every.unionByName(rows)
    return every.join(kept, ["source", "row"], "left").select("source", "row", F.when(F.col("__kept"), "kept").otherwise("erased").alias("status"))


def why(traced: DataFrame, condition: str) -> DataFrame:
    """(source, row) behind the results that fulfil a condition."""
    return traced.filter(condition).select(F.explode("lineage").alias("x")).select("x.*").distinct()


def search_input(traced: DataFrame, source: str, pattern: str) -> DataFrame:
    """Results that come from a row of `source` whose JSON matches the pattern."""
    return traced.filter(F.exists("lineage", lambda x: (x["source"] == source) & F.regexp_like(x["row"], F.lit(pattern))))


def search_output(traced: DataFrame, pattern: str) -> DataFrame:
    """Results whose JSON matches the pattern, with their lineage."""
    out = [c for c in traced.columns if c != "lineage"]
    return traced.filter(F.regexp_like(F.to_json(F.struct(*out)), F.lit(pattern)))
