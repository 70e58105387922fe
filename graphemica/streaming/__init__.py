"""Segmentation is a stateless map, so a stream takes the same functions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphemica import functions as G
from graphemica.operators.segments import explode_segments


def stream_tokens(stream: DataFrame, text_col: str = "text", *, locale: str | None = None) -> DataFrame:
    """Word-like segments of a streaming table, one per row."""
    return explode_segments(stream, text_col, "word", locale=locale).where(G.word_like("segment"))


def count_into_memory(stream: DataFrame, name: str, text_col: str = "text") -> StreamingQuery:
    """Running token counts in a memory table."""
    counts = stream_tokens(stream, text_col).groupBy("segment").count()
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).start()
