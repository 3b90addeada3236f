"""The same operators over streams: analysis is done row by row and keeps no state; counts are kept by windows of event time, and late rows beyond the watermark are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import analyzer


def analyzed(stream: DataFrame, id_col: str, text_col: str, model: analyzer.Model | None = None, options: analyzer.Options | None = None) -> DataFrame:
    """id, rank, score, tokens of each row, as it comes."""
    return analyzer.analyze(stream, id_col, text_col, model, options)


def pattern_spans(stream: DataFrame, id_col: str, text_col: str, match: patterns.Match = patterns.Match.ALL) -> DataFrame:
    return patterns.pattern_spans(stream, id_col, text_col, match)


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, value_col: str | None = None, window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """begin, end, key, n, total: rows and their summed values by key and window of event time."""
    w = F.window(F.col(time_col), window, slide) if slide else F.window(F.col(time_col), window)
    total = F.sum(F.col(value_col)) if value_col else F.lit(0.0)
    counted = stream.withWatermark(time_col, late).groupBy(w.alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"), (total if value_col else F.sum(F.lit(0.0))).alias("total"))
    return counted.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "key", "n", "total")
