"""Kernels against literal cases, against CLDR's rules evaluated place by place, and against ICU in the JVM."""

import random
import time

import pytest

from graphemica.kernels import rules as r
from graphemica.kernels.dictionary import Dictionary, greedy_word
from graphemica.kernels.properties import LINE, class_table
from graphemica.kernels.segment import Segmenter
from graphemica.sources.cldr import read_segments

KNOWN = {k: Dictionary(k) for k in ("th", "lo", "km", "my", "zh")}


def split(text, kind="word", locale=None, words=frozenset()):
    return Segmenter(kind, locale, words=words, dictionaries=KNOWN).split(text)


def places(kind, name, pool, rounds, size):
    """(text, place, whether the kernel breaks there, whether the rules do) for random texts over some of ``pool``."""
    data, seg, rnd = read_segments()[name], Segmenter(kind), random.Random(3)
    rules = r.compile_rules(data.rules, data.variables)
    for _ in range(rounds):
        some = rnd.sample(pool, min(len(pool), rnd.randint(1, 5)))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(1, size)))
        ends = set(seg.ends(text))
        for i in range(1, len(text)):
            yield text, i, i in ends, r.evaluate_rules((text[:i], text[i:]), rules)[0] == "break"


@pytest.mark.parametrize(("kind", "name"), [("grapheme", "grapheme_cluster_break"), ("word", "word_break"), ("sentence", "sentence_break")])
def test_kernels_equal_cldr_rules(kind, name):
    """Three characters of every class.  (Words: CLDR's form of the rule for flags counts no marks before the first.)"""
    flat, rnd, of = class_table(kind).spread(), random.Random(9), {}
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000:
            of.setdefault(chr(flat[c]), []).append(chr(c))
    pool = [x for k, v in sorted(of.items()) if not (kind == "word" and k == "R") for x in rnd.sample(v, min(3, len(v)))]
    seen = list(places(kind, name, pool, 4000, 9))
    assert [x for x in seen if x[2] != x[3]] == [] and len(seen) > 10_000


# Pairs of classes at which the kernel keeps to older rules: numbers by pairs of classes (25), quotation marks by class (15, 19),
# any break after a Hebrew letter and hyphen (21a), and no marks between flags (30a).
OLDER = {("PO", "OP"), ("SY", "NU"), ("PR", "OP"), ("CP", "PO"), ("CP", "PR"), ("HY", "HL"), ("BA", "HL"), ("CM", "OP"), ("CM", "RI"), ("RI", "RI"), ("IS", "PO"), ("SY", "PR"), ("IS", "PR"), ("SY", "PO"), ("SP", "OP"), ("CL", "PO")}


def test_lines_equal_cldr_rules_but_for_older_pairs():
    pool = "a1 -()\"!,/%$|\n\r\u2014\u2026\u00a0\u200b\u2060\u0301\u200d\u4e2d\uac01\u1100\u1161\u11a8\uac00\u05d0\ufffc\u00b4\U0001f466\U0001f3fb\u3005\u0085\u000b\U0001f1e6"
    flat = class_table("line").spread()
    seen = list(places("line", "line_break", pool, 12_000, 5))
    odd = [(text, i) for text, i, kernel, rules in seen if kernel != rules]
    near = lambda text, i: (LINE[flat[ord(text[i - 1])]], LINE[flat[ord(text[i])]])
    assert [(x, near(*x)) for x in odd if near(*x) not in OLDER and not any(LINE[flat[ord(c)]] == "HL" for c in x[0])] == []
    assert len(odd) < 0.01 * len(seen) and len(seen) > 20_000


def icu(spark, kind):
    get = spark._jvm.com.ibm.icu.text.BreakIterator
    make = {"grapheme": get.getCharacterInstance, "word": get.getWordInstance, "sentence": get.getSentenceInstance, "line": get.getLineInstance}[kind]
    it = make(spark._jvm.com.ibm.icu.util.ULocale.ROOT)

    def ends(text):
        it.setText(text)
        it.first()
        wide = text.encode("utf-16-le")
        out = []
        while (at := it.next()) >= 0:
            out.append(len(wide[: 2 * at].decode("utf-16-le")))
        return out

    return ends


MIXED = [
    "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440! 3,14 \u03b1\u03b2\u03b3\u00b7\u03b4 x'y", "\u0915\u094d\u0937\u0924\u094d\u0930\u093f\u092f a\u0301\u0302e", "\U0001f469\u200d\U0001f469\u200d\U0001f467 \U0001f1fa\U0001f1f8\U0001f1ec\U0001f1e7\U0001f1eb",
    "\uac01\u11a8 \u1100\u1161\u11a8\u1100", "Dr. X met (Y). \"Really?\" he asked. No! 3.5 is it.\r\nNext\u2029last", "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643\u0645. \u0643\u064a\u0641 \u061f", "\u05d0\u05d1\"\u05d2 \u05d3\u05d4' x", "a_b 1_2 c.d 1.2 e:f", "  two  spaces\t\ttabs ",
]


@pytest.mark.parametrize("kind", ["grapheme", "word", "sentence", "line"])
def test_kernels_equal_icu(spark, duck, kind):
    """The tables' texts and some in other scripts.  (ICU holds abbreviations apart only in its own locales.)"""
    ends, seg = icu(spark, kind), Segmenter(kind)
    texts = [t for (t,) in duck.execute("SELECT text FROM documents WHERE length(text) < 1500 ORDER BY doc_id LIMIT 25").fetchall()]
    for text in [*texts, *([] if kind == "line" else MIXED)]:
        if text and not (kind == "word" and "\uac01" in text):  # ICU looks Hangul words up
            assert seg.ends(text) == ends(text), text


# Published examples and what they must give.
CASES = [
    ("This is a sentence. And another.", "word", None, ["This", " ", "is", " ", "a", " ", "sentence", ".", " ", "And", " ", "another", "."]),
    ("This is a sentence. And another.", "sentence", None, ["This is a sentence. ", "And another."]),
    ("This is a sentence. And another.", "line", None, ["This ", "is ", "a ", "sentence. ", "And ", "another."]),
    ("No, I don't have a Ph.D. but I don't think it matters.", "sentence", None, ["No, I don't have a Ph.D. but I don't think it matters."]),
    ("“Hi", "word", "en", ["“", "Hi"]),
    ('"Hi ', "word", "en", ['"', "Hi", " "]),
    ('He said, "A cup of hot tea?"', "line", "en", ["He ", "said, ", '"A ', "cup ", "of ", "hot ", 'tea?"']),
    ("Ẹ́va Sophia", "word", "pcm", ["Ẹ́va", " ", "Sophia"]),
    ("one:two", "word", None, ["one:two"]),
    ("abc_キロメートル", "word", None, ["abc_キロメートル"]),
    ("abc_キロメートル", "word", "ja", ["abc_", "キロメートル"]),
    ("", "grapheme", None, []),
    ("🇺🇸🇬🇧🇫", "grapheme", None, ["🇺🇸", "🇬🇧", "🇫"]),
    ("a👨‍👩‍👧b", "grapheme", None, ["a", "👨‍👩‍👧", "b"]),
    ("क्क", "grapheme", None, ["क्क"]),
    ("؀١", "grapheme", None, ["؀١"]),
    ("각ᆨ", "grapheme", None, ["각ᆨ"]),
    ("γδ; Ε", "sentence", "el", ["γδ; ", "Ε"]),
    ("布鲁赫", "word", "zh", ["布", "鲁", "赫"]),
    *[("明德", "word", loc, ["明德"]) for loc in ("zh", "zh_Hant", "zh_Hant_HK", "yue", "yue_Hant", "yue_Hans", "ja")],
    ("สวัสดีเจ้านาย", "word", "th", ["สวัสดี", "เจ้า", "นาย"]),
    ("ສະບາຍດີນາຍຈ້າງ", "word", "lo", ["ສະບາຍດີ", "ນາຍ", "ຈ້າງ"]),
    ("ສະမင်္ဂလာပါ သူဌေး", "word", "my", ["ສ", "ະ", "မင်္ဂလာ", "ပါ", " ", "သူဌေး"]),
    ("ສជំរាបសួរចៅហ្វាយ", "word", "km", ["ສ", "ជំរាបសួរ", "ចៅហ្វាយ"]),
    ("日本語 100 km", "word", "ja", ["日本語", " ", "100", " ", "km"]),
    ("ISO 8601形式の日付", "word", "ja", ["ISO", " ", "8601", "形式", "の", "日付"]),
    ("サンプルCSVファイル", "word", "ja", ["サンプル", "CSV", "ファイル"]),
    ("hello สวัสดี world", "word", "th", ["hello", " ", "สวัสดี", " ", "world"]),
    ("นานๆ", "word", "th", ["นานๆ"]),
]


@pytest.mark.parametrize(("text", "kind", "locale", "expected"), CASES)
def test_literal(text, kind, locale, expected):
    assert split(text, kind, locale) == expected


def test_suppressions():
    words = frozenset({"m", "ph.d", "d"})
    assert split("Non, c'est M. Dubois.", "sentence", "fr", words) == ["Non, c'est M. Dubois."]
    assert split("Non, c'est M. Dubois.", "sentence", "fr") == ["Non, c'est M. ", "Dubois."]
    assert Segmenter("sentence", "fr", suppressions=False, words=words).split("A M. Du") == ["A M. ", "Du"]


SAMPLES = ["布鲁赫", "明德", "สวัสดีเจ้านาย", "ສະບາຍດີນາຍຈ້າງ", "မင်္ဂလာပါ သူဌေး", "ជំរាបសួរចៅហ្វាយ", "hello, 世界 100 km.", "a\r\nb c\n\nd", "🇺🇸 x‍ y", "a" * 5000, "a_" * 3000]


@pytest.mark.parametrize("locale", [None, "zh", "ja", "th", "lo", "km", "my"])
@pytest.mark.parametrize("kind", ["grapheme", "word", "sentence", "line"])
def test_lossless_and_next(kind, locale):
    seg = Segmenter(kind, locale, dictionaries=KNOWN)
    for text in SAMPLES:
        assert "".join(seg.split(text)) == text == "".join(seg.stream(text))
        if len(text) < 100:
            got, rest = [], text
            while found := seg.next(rest):
                got.append(found[0])
                rest = found[1]
            assert got == seg.stream(text)


@pytest.mark.parametrize("kind", ["grapheme", "word", "line"])
def test_is_break_agrees_with_split(kind):
    seg = Segmenter(kind)
    for text in SAMPLES[:9]:
        ends = {0, *seg.ends(text)}
        for i in range(len(text) + 1):
            assert seg.is_break(text[:i], text[i:]) == (i in ends), (text, i)


def test_mixed_text_takes_linear_time():
    """Dictionary locales on text of other scripts before, between and after dictionary runs."""
    for sample in ("word " * 2000 + "\u4e2d", "ab \u4e2d\u6587 " * 1000, "\u660e\u5fb7 x, " * 1000):
        seg = Segmenter("word", "zh", dictionaries=KNOWN)
        seg.split("\u660e\u5fb7")  # the dictionary is read once
        times = []
        for n in (1, 4):
            began = time.process_time()
            assert "".join(seg.split(sample * n)) == sample * n
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 0.2


def naive_greedy(seg, text, dictionary):
    """The definition: the first segment of what is left, cut where the next run begins, again and again."""
    inside, mark, out, at = seg.script(text), seg.marks(text), [], 0
    while at < len(text):
        if inside[at]:
            end = greedy_word(text, at, inside, mark, dictionary)
        else:
            stop = inside.find(1, at)
            end = at + seg.ends(text[at : stop + 1 if stop >= 0 else len(text)])[0]
            end = min(end, stop) if stop >= 0 else end
        out.append(text[at:end])
        at = end
    return out


@pytest.mark.parametrize("locale", ["zh", "ja", "th", "km"])
def test_greedy_by_definition(locale):
    rnd = random.Random(5)
    seg = Segmenter("word", locale, dictionaries=KNOWN)
    pool = "ab1_.,' \r\n\u0301\u200d\U0001f1e6\U0001f469\u660e\u5fb7\u30ad\u30ed\u0e2a\u0e27\u0e31\u1785\u17c5\u05d0\""
    for _ in range(1500):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))
        assert seg.stream(text) == naive_greedy(seg, text, seg.loaded(seg.dictionary)), text


@pytest.mark.parametrize("kind", ["grapheme", "word", "sentence", "line"])
def test_segments_are_found_when_asked_for(kind):
    """A first segment of a long text costs a look-up of its classes, not the walk."""
    seg = Segmenter(kind)
    text = "Some words go here. " * 200_000
    seg.next("x")
    began = time.process_time()
    for _ in range(3):
        assert text.startswith(next(seg.walk(text)))
    assert time.process_time() - began < 1


def test_is_break_literals():
    assert Segmenter("word").is_break("This is ", "some words")
    assert not Segmenter("sentence").is_break("This is ", "some words")
    assert Segmenter("sentence").is_break("This is one. ", "This is some words.")
    assert not Segmenter("sentence").is_break("a\r", "\nb") and Segmenter("sentence").is_break("a\r\n", "b")
    assert not Segmenter("grapheme").is_break("e", "́")
    with pytest.raises(ValueError, match="Unknown break"):
        Segmenter("paragraph")


def test_trim_and_next():
    assert Segmenter("word").next("  a", trim=True) == ("a", "")
    assert Segmenter("line").next('tea"') == ('tea"', "")
    assert Segmenter("word").next("") is None and Segmenter("word").next(None) is None and Segmenter("word").split(None) is None


def test_missing_dictionary_falls_back(tmp_path):
    none = {"th": Dictionary("th", str(tmp_path / "missing.txt"))}
    assert Segmenter("word", "th", dictionaries=none).split("hello world") == ["hello", " ", "world"]
    own = tmp_path / "th.txt"
    own.write_text("# words\nกขค\t5\nงจ\n", encoding="utf-8")
    assert Segmenter("word", "th", dictionaries={"th": Dictionary("th", str(own))}).split("กขคงจ") == ["กขค", "งจ"]


def test_line_dictionary_words():
    assert Segmenter("line", dictionaries=KNOWN).split("ok สวัสดีเจ้านาย x") == ["ok ", "สวัสดี", "เจ้า", "นาย ", "x"]
