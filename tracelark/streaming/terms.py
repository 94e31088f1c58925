"""Term counts of a stream of documents. Only counting appends cleanly; weights and ranks follow from the counts in each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import ir_tokens


def term_counts(stream: DataFrame, text: str = "ir_text", time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """term and n, by windows of the event time where there is one (late rows beyond the watermark are left to the sink)."""
    words = lambda df, *more: df.select(*more, F.explode(ir_tokens(F.col(text))).alias("term"))
    if time is None:
        return words(stream).groupBy("term").agg(F.count("*").alias("n"))
    return words(stream.withWatermark(time, late), time).groupBy(F.window(time, window).alias("window"), "term").agg(F.count("*").alias("n"))
