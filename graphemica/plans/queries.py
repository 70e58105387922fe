"""Registered queries on the driver tables and DuckDB SQL for those that SQL can express.

The SQL is exact for the tables' alphabet (Basic Latin and accented Latin letters).  Relational queries are
compositions: the library adds functions, Spark does the joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphemica import functions as G
from graphemica.kernels import locales
from graphemica.operators.relational import caseless_join, token_counts, top_tokens
from graphemica.operators.segments import explode_segments


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def _n(c) -> F.Column:
    return c.cast("long")


# RE2 has no possessive quantifiers; this is the plain form of the word rules for the tables' alphabet.
_WORDS = r"(?s)(?:_|\p{L}+(?:[.'':]\p{L}+)*|[0-9]+(?:[.,;''][0-9]+)*)+| +|\r\n|."


def _tokens(cols: str, text: str, table: str) -> str:
    return f"SELECT {cols} unnest(regexp_extract_all({text}, '{_WORDS}')) AS segment FROM {table}"


# Sentences of the tables' alphabet, told apart at terminators: {stop} are these, {goes_on} what a sentence goes on with.
_SENTENCES = r"""
WITH t AS (
  SELECT doc_id, lang, unnest(x) AS tok, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, lang, regexp_extract_all(text, '\n|[{stop}]["()]* *\n?|[^{stop}\n]+') AS x FROM {table})
), f AS (
  SELECT *, lead(tok) OVER w AS nxt, lag(tok) OVER w AS prv FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b AS (
  SELECT *, CASE
    WHEN nxt IS NULL THEN 0
    WHEN tok LIKE '%' || chr(10) THEN 1
    WHEN NOT regexp_matches(tok, '^[{stop}]') THEN 0
    WHEN regexp_matches(nxt, '^[{stop}{goes_on}]') THEN 0
    WHEN tok[1] <> '.' THEN 1
    WHEN tok = '.' AND regexp_matches(nxt, '^[0-9]') THEN 0
    WHEN tok = '.' AND regexp_matches(nxt, '^\p{{Lu}}') AND regexp_matches(prv, '\p{{L}}$') THEN 0
    WHEN regexp_matches(nxt, '^[^\p{{L}}]*\p{{Ll}}') THEN 0
    WHEN {listed} THEN 0
    ELSE 1 END AS cut FROM f
), g AS (
  SELECT doc_id, i, tok, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
), s AS (SELECT doc_id, k, string_agg(tok, '' ORDER BY i) AS seg FROM g GROUP BY doc_id, k
), d AS (SELECT doc_id, count(*) AS n, md5(string_agg(seg, '|' ORDER BY k)) AS segments FROM s GROUP BY doc_id)
SELECT {table}.doc_id, coalesce(n, 0) AS n, true AS lossless, coalesce(segments, md5('')) AS segments FROM {table} LEFT JOIN d USING (doc_id)
"""


def _sentences(source: str = "SELECT doc_id, lang, text FROM documents", stop: str = ".!", goes_on: str = ",-", locales: dict[str, str] | None = None) -> str:
    """``locales``: SQL condition on lang -> locale whose abbreviations end no sentence."""
    from graphemica.sources.cldr import suppression_words

    listed = "false"
    for where, locale in (locales or {}).items():
        words = ", ".join(f"'{w}'" for w in sorted(suppression_words(locale)) if w.isalnum())
        listed += f" OR ({where} AND lower(regexp_extract(prv, '([\\p{{L}}0-9]+)$', 1)) IN ({words}))"
    return _SENTENCES.format(table="src", stop=stop, goes_on=goes_on, listed=listed).replace("WITH t AS", f"WITH src AS ({source}), t AS", 1)


# Lines of the tables' alphabet: the rules by pairs of characters, with the spaces between.
_LINES = r"""
WITH t AS (
  SELECT doc_id, unnest(x) AS tok, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '(?:\p{L}+|[0-9]+|\n|[^\p{L}0-9\n ]| ) *') AS x FROM documents)
), c AS (
  SELECT *, rtrim(tok, ' ') AS core, tok <> rtrim(tok, ' ') AS sp,
    CASE WHEN core = '' THEN 'SP' WHEN core = chr(10) THEN 'LF' WHEN regexp_matches(core, '^[\p{L}#&*=@]') THEN 'AL' WHEN regexp_matches(core, '^[0-9]') THEN 'NU' WHEN core IN ('$', '+') THEN 'PR' WHEN core = '%' THEN 'PO'
      WHEN core IN ('.', ',') THEN 'IS' WHEN core = '!' THEN 'EX' WHEN core = '"' THEN 'QU' WHEN core = '(' THEN 'OP' WHEN core = ')' THEN 'CP' WHEN core = '-' THEN 'HY' WHEN core = '|' THEN 'BA' END AS k FROM t
), f AS (
  SELECT *, lead(k) OVER w AS nk, lead(k, 2) OVER w AS nnk, lead(sp) OVER w AS nsp, lag(k) OVER w AS pk, lag(sp) OVER w AS psp FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b AS (
  SELECT *, CASE
    WHEN nk IS NULL THEN 0
    WHEN k = 'LF' AND NOT sp THEN 1
    WHEN nk = 'LF' THEN 0
    WHEN nk IN ('CP', 'EX') THEN 0
    WHEN k = 'OP' THEN 0
    WHEN k = 'QU' AND nk = 'OP' THEN 0
    WHEN nk = 'IS' THEN CASE WHEN sp AND nnk = 'NU' AND NOT nsp THEN 1 ELSE 0 END
    WHEN sp THEN 1
    WHEN k = 'QU' OR nk = 'QU' THEN 0
    WHEN k = 'HY' AND nk = 'AL' AND (pk IS NULL OR psp OR pk = 'LF') THEN 0
    WHEN nk IN ('BA', 'HY') THEN 0
    WHEN nk = 'NU' THEN CASE WHEN k IN ('AL', 'PR', 'PO', 'HY', 'IS', 'NU', 'CP') THEN 0 ELSE 1 END
    WHEN nk = 'AL' THEN CASE WHEN k IN ('AL', 'PR', 'PO', 'NU', 'IS', 'CP') THEN 0 ELSE 1 END
    WHEN nk IN ('PR', 'PO') THEN CASE WHEN k IN ('AL', 'CP', 'NU') THEN 0 ELSE 1 END
    WHEN nk = 'OP' THEN CASE WHEN k IN ('PR', 'PO', 'AL', 'NU') THEN 0 ELSE 1 END
    ELSE 1 END AS cut FROM f
), g AS (
  SELECT doc_id, i, tok, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
), s AS (SELECT doc_id, k, string_agg(tok, '' ORDER BY i) AS seg FROM g GROUP BY doc_id, k
), d AS (SELECT doc_id, count(*) AS n, md5(string_agg(seg, '|' ORDER BY k)) AS segments FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n, true AS lossless, coalesce(segments, md5('')) AS segments FROM documents LEFT JOIN d USING (doc_id)
"""

_LIKE = r"regexp_matches(segment, '[\p{L}\p{N}]')"
_FOLD = "lower(replace({0}, 'ß', 'ss'))"

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def fold(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.fold("text").alias("folded"))


@_query(f"SELECT {_FOLD.format('lang')} AS lang, count(DISTINCT {_FOLD.format('text')}) AS texts, count(*) AS n FROM documents GROUP BY 1")
def fold_group(spark, sf_dir):
    return _docs(spark, sf_dir, "lang", "text").groupBy(G.fold("lang").alias("lang")).agg(F.countDistinct(G.fold("text")).alias("texts"), F.count(F.lit(1)).alias("n"))


@_query("SELECT n_name, upper(n_name) = upper(r_name) AS same, lower(n_name) = lower(upper(n_name)) AS own FROM nation JOIN region ON n_regionkey = r_regionkey")
def equals_ignoring_case(spark, sf_dir):
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    return both.select("n_name", G.equals_ignoring_case("n_name", "r_name").alias("same"), G.equals_ignoring_case("n_name", F.upper("n_name")).alias("own"))


@_query("SELECT a.c_mktsegment AS segment, count(*) AS n FROM customer a JOIN (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer) b ON lower(a.c_mktsegment) = b.s GROUP BY 1")
def caseless_equi_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment")
    return caseless_join(c, c.select(F.lower("c_mktsegment").alias("s")).distinct(), "c_mktsegment", "s").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS upcased FROM documents")
def upcase(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.upcase("text").alias("upcased"))


@_query("SELECT doc_id, lower(text) AS downcased FROM documents")
def downcase(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.downcase("text").alias("downcased"))


# A locale's casing rules hold up to the first character beyond ASCII without a rule there.
_HEAD, _TAIL = r"regexp_extract(t, '^[\x00-\x7F]*')", r"t[length(regexp_extract(t, '^[\x00-\x7F]*')) + 1:]"


@_query(rf"""SELECT doc_id, lower(replace({_HEAD}, 'I', 'ı')) || lower({_TAIL}) AS downcased, upper(replace({_HEAD}, 'i', 'İ')) || upper({_TAIL}) AS upcased
  FROM (SELECT doc_id, replace(text, 'ß', 's') AS t FROM documents)""")
def turkic_case(spark, sf_dir):
    t = F.replace("text", F.lit("ß"), F.lit("s"))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.downcase(t, "tr").alias("downcased"), G.upcase(t, "tr").alias("upcased"))


_LATIN, _GREEK, _GREEK_UPPER = "abgdezhiklmnxoprstuf", "άβγδέζήίκλμνξόπρστύφ", "ΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΦ"


@_query(f"""SELECT doc_id, upper(replace(translate(translate(text, '{_LATIN}', '{_GREEK_UPPER}'), 'äèéíóöüÄÈÉÍÓÖÜ', 'AEEIOOUAEEIOOU'), 'ß', 'ss')) AS upcased FROM documents""")
def greek_upcase(spark, sf_dir):
    """Accents and diaereses go from Greek letters and from Latin ones; other marks stay."""
    greek = F.translate("text", _LATIN, _GREEK)
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.upcase(greek, "el").alias("upcased"))


@_query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_WORDS}'),
  lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '') AS titled FROM documents""")
def titlecase(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.titlecase("text").alias("titled"))


@_query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(text, '{_WORDS}'), '|')) AS segments FROM documents")
def split_words(spark, sf_dir):
    words = G.split("text", "word")
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", words.alias("w")).select("doc_id", _n(F.size("w")).alias("n"), F.md5(F.array_join("w", "|")).alias("segments"))


@_query(f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, '|')) AS segments FROM
  (SELECT doc_id, list_filter(regexp_extract_all(text, '{_WORDS}'), lambda s: NOT regexp_matches(s, '^\\s+$')) AS w FROM documents)""")
def split_words_trimmed(spark, sf_dir):
    words = G.split("text", "word", trim=True)
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", words.alias("w")).select("doc_id", _n(F.size("w")).alias("n"), F.md5(F.array_join("w", "|")).alias("segments"))


@_query(f"SELECT conv_id, turn, segment, count(*) AS n FROM ({_tokens(cols='conv_id, turn,', text='text', table='conversations')}) GROUP BY ALL")
def segments_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return explode_segments(rows).groupBy("conv_id", "turn", "segment").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT segment, {_LIKE} AS word_like, count(*) AS n FROM ({_tokens(cols='', text='text', table='documents')}) GROUP BY ALL")
def word_like(spark, sf_dir):
    counts = explode_segments(_docs(spark, sf_dir, "text")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("segment", G.word_like("segment").alias("word_like"), "n")


@_query(f"SELECT segment AS token, count(*) AS n FROM ({_tokens(cols='', text='text', table='documents')}) WHERE {_LIKE} GROUP BY 1")
def word_counts(spark, sf_dir):
    return token_counts(_docs(spark, sf_dir, "text"))


@_query(f"SELECT {_FOLD.format('segment')} AS token, count(*) AS n FROM ({_tokens(cols='', text='text', table='documents')}) WHERE {_LIKE} GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def top_words(spark, sf_dir):
    return top_tokens(_docs(spark, sf_dir, "text"), 20, caseless=True)


@_query(f"""SELECT lang, token, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS INTEGER) AS rank FROM
  (SELECT lang, segment AS token, count(*) AS n FROM ({_tokens(cols='lang,', text='text', table='documents')}) WHERE {_LIKE} GROUP BY ALL)) WHERE rank <= 5""")
def top_words_by_lang(spark, sf_dir):
    return top_tokens(_docs(spark, sf_dir, "lang", "text"), 5, "text", "lang")


@_query("SELECT doc_id, length_grapheme(text) AS n, md5(text) AS joined FROM documents")
def split_graphemes(spark, sf_dir):
    out = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.split("text", "grapheme").alias("g"))
    return out.select("doc_id", _n(F.size("g")).alias("n"), F.md5(F.array_join("g", "")).alias("joined"))


def _by_row(spark, sf_dir, kind, how=G.split, docs=None):
    docs = (docs or _docs(spark, sf_dir, "doc_id", "text")).select("doc_id", "text", how("text", kind).alias("s"))
    return docs.select("doc_id", _n(F.size("s")).alias("n"), (F.array_join("s", "") == F.col("text")).alias("lossless"), F.md5(F.array_join("s", "|")).alias("segments"))


# A character of the tables -> a cluster: a letter with an accent, a Hangul syllable, a flag, a family and a conjunct.
_CLUSTERS = (("n", "e\u0301"), ("r", "\u1100\u1161\u11a8"), ("s", "\U0001f1fa\U0001f1f8"), ("t", "\U0001f468\u200d\U0001f469\u200d\U0001f467"), ("d", "\u0915\u094d\u0937"))


@_query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CLUSTERS) + " ELSE c END), '|')) AS clusters FROM documents")
def graphemes_mixed_scripts(spark, sf_dir):
    c = F.col("text")
    for a, b in _CLUSTERS:
        c = F.replace(c, F.lit(a), F.lit(b))
    out = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.split(c, "grapheme").alias("g"))
    return out.select("doc_id", _n(F.size("g")).alias("n"), F.md5(F.array_join("g", "|")).alias("clusters"))


# Latin letters -> Cyrillic, Greek and (z) Katakana ones, which join no others.
_ABC, _OTHER = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмνοπρστυωξψζэキ"
_MIXED_WORDS = _WORDS.replace(r"\p{L}", r"[\p{Cyrillic}\p{Greek}\p{Latin}]").replace("| +|", r"|\p{Katakana}+| +|")


@_query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, '|')) AS segments FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_ABC}', '{_OTHER}'), '{_MIXED_WORDS}') AS w FROM documents)")
def words_mixed_scripts(spark, sf_dir):
    out = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.split(F.translate("text", _ABC, _OTHER), "word").alias("w"))
    return out.select("doc_id", _n(F.size("w")).alias("n"), F.md5(F.array_join("w", "|")).alias("segments"))


# Han characters of which no two make a word; runs of other scripts lie between them.
_HAN = "龘"
_HAN_WORDS = _WORDS.replace(r"\p{L}", r"\p{Latin}").replace("(?s)", r"(?s)\p{Han}|")


@_query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, '|')) AS segments FROM (SELECT doc_id, regexp_extract_all(translate(text, 'q', '{_HAN}'), '{_HAN_WORDS}') AS w FROM documents)")
def words_dictionary_locale(spark, sf_dir):
    out = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.split(F.translate("text", "q", _HAN), "word", locale="zh").alias("w"))
    return out.select("doc_id", _n(F.size("w")).alias("n"), F.md5(F.array_join("w", "|")).alias("segments"))


@_query(_sentences())
def split_sentences(spark, sf_dir):
    return _by_row(spark, sf_dir, "sentence")


@_query(_sentences("SELECT doc_id, lang, replace(text, ',', ';') AS text FROM documents", stop=".!;", goes_on="-"))
def sentences_greek(spark, sf_dir):
    """In Greek a semicolon ends a sentence."""
    docs = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.replace("text", F.lit(","), F.lit(";")).alias("text"))
    return _by_row(spark, sf_dir, "sentence", lambda c, kind: G.split(c, kind, locale="el"), docs)


@_query(_sentences("SELECT doc_id, lang, replace(text, ', ', ' Mr. ') AS text FROM documents", locales={"true": "en"}))
def sentences_suppressed(spark, sf_dir):
    """No sentence ends after an abbreviation of the locale."""
    docs = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.replace("text", F.lit(", "), F.lit(" Mr. ")).alias("text"))
    return _by_row(spark, sf_dir, "sentence", lambda c, kind: G.split(c, kind, locale="en"), docs)


@_query(_LINES)
def split_lines(spark, sf_dir):
    return _by_row(spark, sf_dir, "line")


@_query(_LINES)
def stream_lines(spark, sf_dir):
    return _by_row(spark, sf_dir, "line", G.stream)


@_query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS n, true AS lossless, md5(array_to_string(regexp_extract_all(text, '{_WORDS}'), '|')) AS segments FROM documents")
def stream_words(spark, sf_dir):
    return _by_row(spark, sf_dir, "word", G.stream)


@_query("SELECT doc_id, n, segments FROM (" + _sentences(locales={f"lang = '{x}'": x for x in ("en", "de", "es", "fr")}) + ")")
def sentences_by_locale(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang")
    from graphemica.functions.segmentation import split_by_locale

    out = docs.select("doc_id", split_by_locale("text", "lang", "sentence").alias("s"))
    return out.select("doc_id", _n(F.size("s")).alias("n"), F.md5(F.array_join("s", "|")).alias("segments"))


@_query(f"SELECT doc_id, w[1] AS segment, CASE WHEN len(w) > 0 THEN text[length(w[1]) + 1:] END AS rest FROM (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w FROM documents)")
def next_word(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", G.next_segment("text").alias("s")).select("doc_id", "s.segment", "s.rest")


# Texts cut in the middle: whether the cut is the end of a word.
_MIDDLE = f"""SELECT doc_id, text, length(text) // 2 AS mid, text = '' OR mid = 0 OR coalesce(bool_or(upto = mid), false) AS boundary FROM (
  SELECT doc_id, text, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM
    (SELECT doc_id, text, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS x FROM documents))
  UNION ALL SELECT doc_id, text, 0 FROM documents) GROUP BY doc_id, text"""


def _halves(spark, sf_dir):
    mid = F.floor(F.length("text") / 2).cast("int")
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.substr("text", F.lit(1), mid).alias("a"), F.substr("text", mid + 1).alias("z"))


@_query(f"SELECT doc_id, CASE WHEN boundary THEN 'break' ELSE 'no_break' END AS op, md5(text[:mid]) AS before, CASE WHEN mid = 0 THEN '' ELSE text[mid + 1:mid + 1] END AS matched, md5(CASE WHEN mid = 0 THEN text ELSE text[mid + 2:] END) AS rest FROM ({_MIDDLE})")
def break_at(spark, sf_dir):
    cut = _halves(spark, sf_dir).select("doc_id", G.break_at("a", "z").alias("b"))
    return cut.select("doc_id", "b.op", F.md5("b.before").alias("before"), "b.matched", F.md5("b.rest").alias("rest"))


@_query(f"SELECT doc_id, boundary AS word, true AS grapheme FROM ({_MIDDLE})")
def is_break(spark, sf_dir):
    return _halves(spark, sf_dir).select("doc_id", G.is_break("a", "z").alias("word"), G.is_break("a", "z", "grapheme").alias("grapheme"))


# The evaluator of rules, place by place: with letters and spaces only, words end at changes between these.
@_query(r"""SELECT n_nationkey, i AS place, CASE WHEN n_name[i:i] = ' ' AND n_name[i + 1:i + 1] = ' ' THEN 'no_break' WHEN n_name[i:i] = ' ' OR n_name[i + 1:i + 1] = ' ' THEN 'break' ELSE 'no_break' END AS op
  FROM (SELECT n_nationkey, n_name, unnest(generate_series(1, length(n_name) - 1))::INT AS i FROM nation)""")
def rule_decisions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = n.select("n_nationkey", F.posexplode(G.decide_by_rules("n_name", "word")).alias("p", "op"))
    return out.select("n_nationkey", (F.col("p") + 1).alias("place"), "op")


@_query("SELECT lang, strlen(lang) IN (2, 3) AS is_language, strlen(lang) = 4 AS is_script, strlen(lang) = 2 AS is_territory, count(*) AS n FROM documents GROUP BY ALL")
def tag_guards(spark, sf_dir):
    return _docs(spark, sf_dir, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", G.is_language("lang").alias("is_language"), G.is_script("lang").alias("is_script"), G.is_territory("lang").alias("is_territory"), "n")


_LOCALES = ("fr", "en", "ar", "en-US", "zh_Hant_HK", "yue_Hant", "tr", "az_Latn", "lt", "nl", "el", "th", "xx")
_RESOLVED = (
    ("fr", "fr", "fr", "any"), ("en", "en", "en", "any"), ("ar", "root", "root", "any"), ("en-US", "en-US", "en-US", "any"), ("zh_Hant_HK", "zh-Hant-HK", "zh", "any"),
    ("yue_Hant", "yue-Hant", "root", "any"), ("tr", "root", "root", "tr"), ("az_Latn", "root", "root", "az"), ("lt", "root", "root", "lt"), ("nl", "root", "root", "nl"), ("el", "el", "el", "el"), ("th", "th", "root", "any"), ("xx", "root", "root", "any"),
)


@_query("SELECT * FROM (VALUES " + ", ".join(map(str, _RESOLVED)) + ") t(locale, word_locale, line_locale, casing_locale)")
def locale_resolution(spark, sf_dir):
    rows = [(x, locales.segmentation_locale("word", x), locales.segmentation_locale("line", x), locales.casing_locale(x)) for x in _LOCALES]
    return spark.createDataFrame(rows, "locale string, word_locale string, line_locale string, casing_locale string")


@_query("SELECT * FROM (VALUES ('de', 241), ('en', 151), ('es', 164), ('fr', 82), ('it', 45), ('pt', 172), ('ru', 18), ('en-US', 151), ('en-US-POSIX', 151)) t(locale, n)")
def suppression_counts(spark, sf_dir):
    from graphemica.sources.cldr import suppressions_frame

    return suppressions_frame(spark).groupBy("locale").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _xml(kind: str, columns: str) -> str:
    """The bundled LDML files read as text: one row for each element of a kind, with its file and type."""
    from graphemica.sources.cldr import BUNDLED

    plain = "replace(replace(replace(trim({0}), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"""WITH f AS (SELECT replace(regexp_extract(filename, '([^/]+).xml$', 1), '_', '-') AS locale, content FROM read_text('{BUNDLED}/*.xml')),
      s AS (SELECT locale, unnest(regexp_extract_all(content, '(?s)<segmentation type="[A-Za-z]+">.*?</segmentation>')) AS part FROM f),
      e AS (SELECT locale, regexp_extract(part, 'type="([A-Za-z]+)"', 1) AS type, unnest(x) AS el, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(part, '(?s)<{kind} id="[^"]*">.*?</{kind}>') AS x FROM s))
      SELECT locale, lower(regexp_replace(type, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS break_type, {columns.format(id="regexp_extract(el, 'id=\"([^\"]*)\"', 1)", value=plain.format("regexp_extract(el, '(?s)\">(.*)</', 1)"))} FROM e"""


def _own(spark, which: int):
    """Variables (0) or rules (1) of the locales that have a file, without those of their ancestors."""
    from graphemica.sources.cldr import read_ldml, segment_files

    out = []
    for locale, path in segment_files().items():
        for kind, data in read_ldml(path).items():
            out += [(locale, kind, i, n, v) for i, (n, v) in enumerate(data.variables)] if which == 0 else [(locale, kind, n, v) for n, v in data.rules]
    return spark.createDataFrame(out, "locale string, break_type string, ordinal int, name string, value string" if which == 0 else "locale string, break_type string, id double, value string")


@_query(_xml("variable", "CAST(i - 1 AS INT) AS ordinal, {id} AS name, {value} AS value"))
def segment_variables(spark, sf_dir):
    return _own(spark, 0)


@_query(_xml("rule", "CAST({id} AS DOUBLE) AS id, {value} AS value"))
def segment_rules(spark, sf_dir):
    return _own(spark, 1)


@_query("SELECT * FROM (VALUES ('line_break', 84, 84), ('grapheme_cluster_break', 13, 13), ('word_break', 22, 24), ('sentence_break', 11, 11)) t(break_type, root, ja)")
def segment_rule_counts(spark, sf_dir):
    """Rules of a locale after those of its ancestors."""
    from graphemica.sources.cldr import segment_frames

    counts = [segment_frames(spark, None, loc)[1].groupBy("break_type").agg(F.count(F.lit(1)).cast("int").alias(loc)) for loc in ("root", "ja")]
    return counts[0].join(counts[1], "break_type")


_KNOWN = {"casing": "az el lt nl tr", "dictionary": "zh th lo my km ja zh-Hant zh-Hant-HK yue yue-Hant yue-Hans", "segmentation": "de el en en-US en-US-POSIX es fi fr it ja pt root ru sv zh zh-Hant"}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in _KNOWN.items() for x in v.split()) + ") t(kind, locale)")
def known_locales(spark, sf_dir):
    rows = {"casing": locales.special_casing_locales(), "dictionary": locales.known_dictionary_locales(), "segmentation": locales.known_segmentation_locales()}
    return spark.createDataFrame([(k, x) for k, v in rows.items() for x in v], "kind string, locale string")


@_query("SELECT * FROM (VALUES ('en-US-POSIX', 'en-US-POSIX>en-US>en>root'), ('en-US', 'en-US>en>root'), ('zh-Hant', 'zh-Hant>zh>root'), ('de', 'de>root'), ('root', 'root')) t(locale, chain)")
def locale_ancestors(spark, sf_dir):
    return spark.createDataFrame([(x, ">".join(locales.ancestors(x))) for x in ("en-US-POSIX", "en-US", "zh-Hant", "de", "root")], "locale string, chain string")


def _message(f, *args) -> str:
    try:
        f(*args)
    except ValueError as e:
        return str(e)
    return ""


_MESSAGES = (
    ("break", "Unknown break 'paragraph'. Valid breaks are grapheme, word, line, sentence"), ("locale", "Unknown locale 'xx'"), ("type", "Unknown segment type 'paragraph_break'"),
    ("variable", "Unknown variable $Nope"), ("casing", "Unknown locale 'xx'"),
)


@_query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _MESSAGES) + ") t(what, message)")
def error_messages(spark, sf_dir):
    from graphemica.kernels.rules import expand_variables
    from graphemica.sources.cldr import segment_data

    rows = [
        ("break", _message(locales.check_break, "paragraph")), ("locale", _message(locales.ancestors, "xx")), ("type", _message(segment_data, "en", "paragraph_break")),
        ("variable", _message(expand_variables, [("$A", "$Nope")])), ("casing", locales.unknown_locale_error("xx")),
    ]
    return spark.createDataFrame(rows, "what string, message string")


# Casing by context: final sigma, dots of Lithuanian letters, Turkic dots, Greek accents, Dutch digraphs.
_CASES = (
    ("downcase", "any", "ΣΟΦΟΣ", "σοφος"), ("downcase", "any", "Σ", "σ"), ("downcase", "any", "ΣΑ", "σα"), ("downcase", "lt", "I\u0300", "i\u0307\u0300"), ("downcase", "lt", "Ì", "i\u0307\u0300"), ("downcase", "lt", "Ia", "ia"),
    ("downcase", "tr", "DİYARBAKIR", "diyarbakır"), ("downcase", "tr", "\u0307I", "\u0307i"), ("upcase", "tr", "ii", "İİ"), ("upcase", "any", "straße", "STRASSE"), ("upcase", "el", "ΐ άλφα", "Ι ΑΛΦΑ"), ("upcase", "lt", "i\u0307", "I\u0307"),
    ("titlecase", "nl", "ijsselmeer", "IJsselmeer"), ("titlecase", "any", "ǆ ßa", "ǅ Ssa"), ("titlecase", "az", "island", "İsland"),
)


@_query("SELECT * FROM (VALUES " + ", ".join(map(str, _CASES)) + ") t(op, locale, text, cased)")
def casing_contexts(spark, sf_dir):
    df = spark.createDataFrame([c[:3] for c in _CASES], "op string, locale string, text string")
    cased = F.lit(None).cast("string")
    for op, locale in dict.fromkeys(c[:2] for c in _CASES):
        cased = F.when((F.col("op") == op) & (F.col("locale") == locale), getattr(G, op)("text", locale)).otherwise(cased)
    return df.select("*", cased.alias("cased"))


@_query(f"""SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, segment FROM (SELECT conv_id, turn, unnest(x) AS segment, generate_subscripts(x, 1) AS i FROM
  (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '{_WORDS}'), lambda s: NOT regexp_matches(s, '^\\s+$')) AS x FROM conversations))""")
def segments_function(spark, sf_dir):
    """The table function in SQL, whose segments are found one by one."""
    from graphemica.operators.segments import register

    register(spark)
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("gm_conversations")
    return spark.sql("SELECT conv_id, turn, pos, segment FROM gm_conversations, LATERAL gm_segments(text, 'word', 'root', true)")


@_query(f"SELECT conv_id, turn, {_FOLD.format('text')} AS folded, upper(replace(text, 'ß', 'ss')) AS upcased, lower(text) AS downcased, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS INT) AS words FROM conversations")
def sql_functions(spark, sf_dir):
    from graphemica.operators.segments import register

    register(spark)
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("gm_turns")
    return spark.sql("SELECT conv_id, turn, gm_fold(text) AS folded, gm_upcase(text) AS upcased, gm_downcase(text) AS downcased, size(gm_words(text)) AS words FROM gm_turns")


_DICTIONARY = (
    ("zh", "布鲁赫", "布|鲁|赫"), ("yue_Hant", "明德", "明德"), ("th", "สวัสดีเจ้านาย", "สวัสดี|เจ้า|นาย"), ("lo", "ສະບາຍດີນາຍຈ້າງ", "ສະບາຍດີ|ນາຍ|ຈ້າງ"),
    ("th", "นานๆ", "นานๆ"), ("th", "กข", "กข"), ("th", "hello สวัสดี world", "hello| |สวัสดี| |world"), ("zh_Hant_HK", "明德", "明德"), ("ja", "サンプルCSVファイル", "サンプル|CSV|ファイル"), ("lo", "ok ສະບາຍດີ", "ok| |ສະບາຍດີ"),
    ("my", "မင်္ဂလာပါ သူဌေး", "မင်္ဂလာ|ပါ| |သူဌေး"), ("km", "ជំរាបសួរចៅហ្វាយ", "ជំរាបសួរ|ចៅហ្វាយ"), ("ja", "ISO 8601形式の日付", "ISO| |8601|形式|の|日付"), ("en", "abc_キロ", "abc_キロ"),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _DICTIONARY) + ") t(locale, text, words)")
def dictionary_words(spark, sf_dir):
    from graphemica.functions.segmentation import split_by_locale

    rows = spark.createDataFrame([(a, b) for a, b, _ in _DICTIONARY], "locale string, text string")
    return rows.select("locale", "text", F.array_join(split_by_locale("text", "locale"), "|").alias("words"))


@_query("SELECT * FROM (VALUES ('ab'), ('c d'), ('e')) t(word)")
def dictionary_lines(spark, sf_dir):
    """A dictionary as text: comments, empty lines and what follows a tab don't count."""
    from graphemica.kernels.dictionary import parse_lines

    return spark.createDataFrame([(w,) for w in parse_lines(["\ufeff# words", "", "ab\t12", "c d", " e "])], "word string")


@_query("SELECT * FROM (VALUES ('Weiß', 'weiss', 'weiss'), ('I', 'i', 'ı'), ('İ', 'i̇', 'i')) t(text, folded, turkic)")
def fold_modes(spark, sf_dir):
    rows = spark.createDataFrame([("Weiß",), ("I",), ("İ",)], "text string")
    return rows.select("text", G.fold("text").alias("folded"), G.fold("text", "turkic").alias("turkic"))
