import random

import pytest
from pyspark.sql import functions as F

from graphemica import functions as G
from graphemica.functions.segmentation import split_by_locale
from graphemica.kernels import casing
from graphemica.kernels.segment import Segmenter
from graphemica.operators import segments as S
from graphemica.operators.relational import caseless_join, top_tokens
from graphemica.sources.cldr import suppressions
from graphemica.streaming import count_into_memory

TEXTS = ["Weiß GRÜSSEN don't", "Ẹ́va Sophia", "", None, "ΟΔΟΣ ΑΒ Σ", "ﬁne ŉ İI ß", "12.5 a_b a:b x,y 1,2 a.b. ­ soft", "naïve\r\n\tTab  two", "ǆ Ǆ ǅ ŉa", "日本語 ok", "ſtraſse K ς", "a\u0085b c\x0bd"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def got(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


@pytest.mark.parametrize("kind", ["word", "grapheme", "sentence", "line"])
def test_split_equals_kernel(df, kind):
    seg = Segmenter(kind)
    assert got(df, G.split("text", kind)) == [seg.split(t) for t in TEXTS]
    assert got(df, G.stream("text", kind)) == [seg.stream(t) for t in TEXTS]


def test_casing_equals_kernel(df):
    for mode in (None, "turkic"):
        assert got(df, G.fold("text", mode)) == [casing.fold(t, mode) for t in TEXTS]
    for locale in (None, "tr", "lt", "el", "nl"):
        assert got(df, G.upcase("text", locale)) == [casing.upcase(t, locale) for t in TEXTS]
        assert got(df, G.downcase("text", locale)) == [casing.downcase(t, locale) for t in TEXTS]
    seg = Segmenter("word")
    assert got(df, G.titlecase("text")) == [t if t is None else "".join(casing.title_word(w) for w in seg.stream(t)) for t in TEXTS]
    assert got(df.limit(1), G.titlecase(F.lit("ijsland THE"), "nl")) == ["IJsland The"]


def test_fold_covers_every_character(spark):
    chars = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    text = "\n".join(chars)
    latin = "\n".join(chars[:0xFF])
    got = spark.createDataFrame([(text,), (latin,)], "t string").select(G.fold("t")).collect()
    assert [r[0] for r in got] == [text.casefold(), latin.casefold()]


def test_literals(spark):
    one = spark.range(1)
    assert one.select(G.split(F.lit("a b  c "), trim=True)).first()[0] == ["a", "b", "c"]
    assert one.select(G.is_break(F.lit("This is "), F.lit("some"))).first()[0] is True
    assert one.select(G.break_at(F.lit("This is "), F.lit("some words"))).first()[0].asDict() == {"op": "break", "before": "This is ", "matched": "s", "rest": "ome words"}
    assert one.select(G.break_at(F.lit(""), F.lit("ab"))).first()[0].asDict() == {"op": "break", "before": "", "matched": "", "rest": "ab"}
    assert one.select(G.next_segment(F.lit("  a"), trim=True)).first()[0].asDict() == {"segment": "a", "rest": ""}
    assert one.select(G.next_segment(F.lit(""))).first()[0] is None
    likes = {"sentence": True, "can't": True, "123": True, "١٢٣": True, "中文": True, "カタカナ": True, " ": False, ".": False, "_": False, "—": False, "": False}
    assert [one.select(G.word_like(F.lit(k))).first()[0] for k in likes] == list(likes.values())
    with pytest.raises(ValueError, match="Unknown break"):
        G.split("text", "paragraph")
    assert one.select(G.is_language(F.lit("en")), G.is_script(F.lit("Latn")), G.is_territory(F.lit("GB"))).first() == (True, True, True)
    with pytest.raises(ValueError, match="dictionary"):
        G.is_break(F.lit("a"), F.lit("b"), "word", locale="th", dictionary_paths={"th": "/nowhere"})


def test_resources_equal_icu(spark):
    """The files as read here against ICU's own reader in the JVM."""
    from graphemica.sources.icu import sentence_exceptions

    bundles = spark._jvm.com.ibm.icu.util.UResourceBundle
    for locale in ("de", "en", "es", "fr", "it", "pt", "ru"):
        listed = bundles.getBundleInstance("com/ibm/icu/impl/data/icudata/brkitr", locale).get("exceptions").get("SentenceBreak")
        assert list(sentence_exceptions(locale)) == [listed.getString(i) for i in range(listed.getSize())]
    assert sentence_exceptions("fi") == sentence_exceptions("xx") == ()


def test_suppressions(spark):
    assert {x: len(suppressions(x)) for x in ("de", "en", "es", "fr", "it", "pt", "ru", "root", "en-US")} == {"de": 241, "en": 151, "es": 164, "fr": 82, "it": 45, "pt": 172, "ru": 18, "root": 0, "en-US": 151}
    rows = spark.createDataFrame([("Non, c'est M. Dubois.", "fr"), ("Non, c'est M. Dubois.", "xx"), (None, "fr"), ("a. B", None)], "t string, lang string")
    assert [r[0] for r in rows.select(split_by_locale("t", "lang", "sentence")).collect()] == [["Non, c'est M. Dubois."], ["Non, c'est M. ", "Dubois."], None, ["a. ", "B"]]
    assert rows.limit(1).select(G.split("t", "sentence", locale="fr", suppressions=False)).first()[0] == ["Non, c'est M. ", "Dubois."]


def test_table_function_and_sql(spark):
    S.register(spark)
    out = spark.sql("SELECT pos, segment, start, `end`, word_like FROM gm_segments('a b.', 'word', 'root', true)").collect()
    assert [tuple(r) for r in out] == [(0, "a", 0, 1, True), (1, "b", 2, 3, True), (2, ".", 3, 4, False)]
    assert spark.sql("SELECT gm_fold('Weiß'), gm_words('a b'), gm_sentences('A. B')").first() == ("weiss", ["a", " ", "b"], ["A. ", "B"])


def test_relational(spark):
    a = spark.createDataFrame([("STRASSE", 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([("straße", 3)], "j string, w int")
    assert caseless_join(a, b, "k", "j").select("v", "w").collect() == [(1, 3)]
    assert [tuple(r) for r in top_tokens(spark.createDataFrame([("a b A. c",)], "text string"), 2, caseless=True).collect()] == [("a", 2), ("b", 1)]


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a b a",), ("b.",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = count_into_memory(stream, "tokens")
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("tokens").collect()} == {("a", 2), ("b", 2)}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("locale", [None, "tr", "az", "lt", "el", "nl"])
def test_casing_columns_equal_kernels(spark, locale, strict):
    """Expressions and kernels by turns: the same results on every row."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("iIıİjJ aéÉßΣσΑ\u0307\u0300Ìį.1") for _ in range(rnd.randint(0, 7))) for _ in range(600)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.upcase("t", locale, strict).alias("u"), G.downcase("t", locale, strict).alias("d")).collect()
    for r in rows:
        assert r.u == casing.upcase(r.t, locale, strict) and r.d == casing.downcase(r.t, locale, strict), r
