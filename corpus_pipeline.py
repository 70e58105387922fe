"""A corpus pipeline: language ID, near dedup, substring dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  ``docs`` has the columns of documents; any further columns, whatever their names, are kept
by all stages but the last.  An empty table stays empty in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphemica.llm.buckets import shared_folder
from graphemica.llm.decontaminate import LEAST, contamination
from graphemica.llm.language_id import identify
from graphemica.llm.minhash_dedup import keep_first, minhash_dedup
from graphemica.llm.sentencepiece_viterbi import encode_pieces
from graphemica.llm.substring_dedup import substring_dedup

#: A prediction below this score (1 / languages is chance) is a rejection, and so is a text without letters.
LEAST_SCORE = 0.4


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not ``und``, and by a score of LEAST_SCORE or more.

    Null and empty texts and those without letters go; very long texts are read whole; repeated rows fare alike; a
    null id or lang is no reason to go; ties between languages go to the first in alphabetical order.
    """
    lang, score = _fresh(docs, "lang_pred"), _fresh(docs, "score")
    told = identify(docs, lang_name=lang, score_name=score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, then of the least hash of its text.

    Of repeated rows the least by all columns stays, so a rerun keeps the same.  Rows with a null id stay; null and
    empty texts are groups of their own; unlike texts under one id are different documents; very long texts are
    taken whole.
    """
    return keep_first(docs, minhash_dedup(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that loses all its words goes; n_chars follows the text.

    A text that loses nothing stays as it is, null and empty ones too; what is cut is joined by single spaces.  Rows
    with a null id come last, rows of one id in the order of a hash of their texts; of repeated rows the first stays;
    very long texts are cut like any other.
    """
    row = docs.select("doc_id", "text", F.struct(*_columns(docs)).alias("row"))
    cut = substring_dedup(row, carry=("row",)).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row.text" if c == "text" else "row.n_chars")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of LEAST bytes or more; shorter ones are no evidence.

    A row is judged by its own text, so it may stay while another of its id, or without one, goes; null and empty texts
    stay; very long texts are scanned whole; repeated rows fare alike.
    """
    key = _fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).where(F.col("item_bytes") >= LEAST)
    return keyed.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of what is left.

    Null and empty texts have no ids; very long texts are encoded whole; a null id stays null; repeated rows have equal
    ids; other columns, whatever their names, end here.
    """
    import public_tokenizers

    return encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontaminated),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Their tables go to the shared folder of the cluster."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs


#: No stage but the third has a form in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
