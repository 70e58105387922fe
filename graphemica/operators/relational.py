"""Relational compositions on segments and folded keys: ordinary joins, aggregates and windows of Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphemica import functions as G
from graphemica.operators.segments import explode_segments


def caseless_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", mode: str | None = None) -> DataFrame:
    """Equi-join on the folded keys, so that Spark can hash, sort or broadcast it and split skew."""
    a = left.withColumn("__key", G.fold(left_key, mode))
    b = right.withColumn("__key", G.fold(right_key, mode))
    return a.join(b, "__key", how).drop("__key")


def token_counts(df: DataFrame, text_col: str = "text", *by: str, caseless: bool = False) -> DataFrame:
    """Counts of word-like tokens, by further columns if named.

    Counts are summed before the shuffle, and what is asked of a token (whether it is like a word, how it folds) is
    asked once for each distinct segment and not for each occurrence.
    """
    counts = explode_segments(df.select(text_col, *by), text_col).groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("n"))
    words = counts.where(G.word_like("segment")).withColumnRenamed("segment", "token")
    return words.groupBy(*by, G.fold("token").alias("token")).agg(F.sum("n").alias("n")) if caseless else words.select(*by, "token", "n")


def top_tokens(df: DataFrame, k: int, text_col: str = "text", *by: str, caseless: bool = False) -> DataFrame:
    """The k most frequent tokens (of each group): ties go to the smaller token."""
    counts = token_counts(df, text_col, *by, caseless=caseless)
    if not by:
        return counts.orderBy(F.desc("n"), "token").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
