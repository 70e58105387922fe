"""Segments as rows: a DataFrame operator and a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphemica import functions as G
from graphemica.functions.segmentation import segmenter
from graphemica.kernels.segment import is_white

_ROW = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("word_like", T.BooleanType())])


def explode_segments(df: DataFrame, text_col: str = "text", break_type: str = "word", *, locale: str | None = None, suppressions: bool = True, trim: bool = False, lazy: bool = False) -> DataFrame:
    """A row for each segment: the columns of ``df``, then pos (from 0) and segment.  No shuffle."""
    cut = (G.stream if lazy else G.split)(text_col, break_type, locale=locale, suppressions=suppressions, trim=trim)
    return df.select("*", F.posexplode(cut).alias("pos", "segment"))


class _Segments:
    """One text's segments, each found when the one before it has been taken: a limit ends the walk."""

    def eval(self, text: str, break_type: str, locale: str, trim: bool) -> Iterator[tuple]:
        if text is None:
            return
        known = self.__dict__.setdefault("known", {})
        if (break_type, locale) not in known:
            known[break_type, locale] = segmenter(break_type or "word", locale)
        import regex

        at = 0
        pos = 0
        for s in known[break_type, locale].walk(text):
            if not (trim and is_white(s)):
                yield pos, s, at, at + len(s), regex.search(r"[\p{Alphabetic}\p{N}]", s) is not None
                pos += 1
            at += len(s)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold_sql() -> str:
    """``fold`` as SQL text."""
    from graphemica.functions.casing import _fold_tables

    source, target, several = _fold_tables()
    folded = f"translate(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(source)}, {_quoted(target)})"
    full = folded
    for a, b in several:
        full = f"replace({full}, {_quoted(a)}, {_quoted(b)})"
    some = "[" + "".join(a for a, _ in several) + "]"
    return f"CASE WHEN NOT rlike(t, {_quoted('[^\\x00-\\xFF]')}) THEN replace(replace(lower(t), '\u00df', 'ss'), '\u00b5', '\u03bc') WHEN rlike(t, {_quoted(some)}) THEN {full} ELSE {folded} END"


def register(spark: SparkSession) -> None:
    """SQL names: gm_fold, gm_upcase, gm_downcase, gm_words, gm_graphemes, gm_sentences, gm_lines, gm_segments.

    The first five are SQL functions, which the optimiser puts into the query; where a text needs a kernel, they and
    the next two call Arrow functions of the same name with ``_kernel`` behind it.  gm_segments is a table function.
    """
    from graphemica.functions.casing import _kernel
    from graphemica.functions.segmentation import LATIN, _arrow, native_pattern
    from graphemica.kernels import casing

    def define(name: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")

    spark.udf.register("gm_downcase_kernel", _kernel(casing.downcase, None, False))
    for name, kind in (("gm_words", "word"), ("gm_graphemes", "grapheme"), ("gm_sentences", "sentence"), ("gm_lines", "line")):
        spark.udf.register(f"{name}_kernel", _arrow(segmenter(kind).split, T.ArrayType(T.StringType())))
    define("gm_fold", "STRING", _fold_sql())
    define("gm_upcase", "STRING", "upper(t)")
    define("gm_downcase", "STRING", "CASE WHEN contains(t, '\u03a3') THEN gm_downcase_kernel(CASE WHEN contains(t, '\u03a3') THEN t END) ELSE lower(t) END")
    for name, kind in (("gm_words", "word"), ("gm_graphemes", "grapheme")):
        latin = f"rlike(t, {_quoted(LATIN)})"
        define(name, "ARRAY<STRING>", f"CASE WHEN {latin} THEN regexp_extract_all(t, {_quoted(native_pattern(kind))}, 0) ELSE {name}_kernel(CASE WHEN NOT {latin} THEN t END) END")
    for name in ("gm_sentences", "gm_lines"):
        define(name, "ARRAY<STRING>", f"{name}_kernel(t)")
    spark.udtf.register("gm_segments", F.udtf(_Segments, returnType=_ROW))
