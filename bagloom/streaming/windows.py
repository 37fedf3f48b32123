"""Event-time windows over streams and tables: tumbling, sliding and session windows with late data dropped by a watermark.

They go beyond the query language; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def windowed(df: DataFrame, time: str, size: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) per window of `size`, every `slide` (default: size)."""
    w = F.window(time, size, slide or size)
    out = _late(df, time, late).groupBy(w.alias("__w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c != "__w"])


def sessions(df: DataFrame, time: str, gap: str, aggregates: list[Column], keys: list[str], late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) per run of events with less than `gap` between them."""
    out = _late(df, time, late).groupBy(F.session_window(time, gap).alias("__w"), *keys).agg(*aggregates)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c != "__w"])
