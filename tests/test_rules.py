import pytest

from graphemica.kernels import rules as r
from graphemica.sources.cldr import read_segments, segment_data, segment_files, segment_frames

ROOT = """<ldml><segmentations><segmentation type="WordBreak"><variables>
<variable id="$L">[a-z]</variable><variable id="$Mid">[.']</variable><variable id="$X">[$L-[x]]</variable></variables>
<segmentRules><rule id="6"> $L × $Mid $L </rule><rule id="5"> $L × $L </rule><rule id="7"> $L $Mid × $L </rule></segmentRules></segmentation></segmentations></ldml>"""
EN = """<ldml><segmentations><segmentation type="SentenceBreak"><suppressions><suppression>Mr.</suppression></suppressions></segmentation></segmentations></ldml>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "root.xml").write_text(ROOT)
    (tmp_path / "en.xml").write_text(EN)
    return tmp_path


def test_rules(folder):
    data = read_segments(folder, "en-US")
    assert data["sentence_break"].suppressions == ["Mr."]
    word = data["word_break"]
    rules = r.compile_rules(word.rules, word.variables)
    assert [x.seq for x in rules] == [5, 6, 7]
    assert r.evaluate_rules(("a", "b c"), rules) == ("no_break", ("a", ("b", " c")))
    assert r.evaluate_rules(("a", "'b"), rules)[0] == "no_break" and r.evaluate_rules(("a", "' "), rules)[0] == "break"
    assert r.evaluate_rules(("a'", "b"), rules)[0] == "no_break"
    assert r.evaluate_rules("ab", rules) == ("break", ("", ("a", "b"))) and r.evaluate_rules(("a", ""), rules) == ("break", ("a", ("", "")))


def test_variables():
    assert r.expand_variables([("$A", "x"), ("$B", "[$A]"), ("$A", "($A|y)")]) == {"A": "(x|y)", "B": "[x]"}
    with pytest.raises(ValueError, match="Unknown variable"):
        r.expand_variables([("$B", "$Nope")])
    with pytest.raises(ValueError):
        r.compile_rule(1.0, "no operator", {})
    assert r.suppressions_variable([]) is None and r.suppressions_variable(["Mr."])[0] == "$Suppressions"


def test_tailorings():
    """Locales whose files change rules or variables of root."""
    word = lambda loc: r.compile_rules(*(lambda d: (d.rules, d.variables))(segment_data(loc, "word_break")))
    line = lambda loc: r.compile_rules(*(lambda d: (d.rules, d.variables))(segment_data(loc, "line_break")))
    op = lambda rules, a, b: r.evaluate_rules((a, b), rules)[0]
    assert (op(word("root"), "\u3042", "\u3044"), op(word("ja"), "\u3042", "\u3044")) == ("break", "no_break")
    # a locale's variables come after all of root's: what root has already made of them stays
    last = lambda loc, kind: segment_data(loc, kind).variables[-1]
    assert last("el", "sentence_break") == ("$STerm", "[[$STerm] [\\u003B \\u037E]]") and last("fi", "word_break") == last("sv", "word_break") == ("$MidLetter", "\\p{Word_Break=MidLetter}")
    assert [n for n, _ in segment_data("en-US-POSIX", "word_break").variables[-2:]] == ["$MidNumLet", "$MidNum"]
    assert (op(line("root"), "a", "\u3041"), op(line("ja"), "a", "\u3041")) == ("no_break", "break") == (op(line("root"), "a", "\u3041"), op(line("zh-Hant"), "a", "\u3041"))
    assert set(segment_files()) == {"root", "el", "ja", "zh", "zh-Hant", "fi", "sv", "en-US-POSIX"}


def test_suppressions_rule():
    d = read_segments()["sentence_break"]
    rules = r.compile_rules(d.rules, d.variables, ["Mr.", "Ph.D."])
    assert [x.seq for x in rules if x.seq > 10][:2] == [10.5, 11.0]
    assert r.evaluate_rules(("Hi Mr. ", "Smith"), rules) == ("no_break", ("Hi Mr. ", ("Hi ", "Mr. ")))
    assert r.evaluate_rules(("Mr. ", ""), rules) == ("no_break", ("Mr. ", ("Mr. ", "")))
    assert r.evaluate_rules(("Hi Mx. ", "Smith"), rules)[0] == "break"


def test_unknown_types_and_locales():
    with pytest.raises(ValueError, match="Unknown segment type 'paragraph_break'"):
        segment_data("en", "paragraph_break")
    with pytest.raises(ValueError, match="Unknown locale 'xx'"):
        segment_data("xx", "word_break")


def test_frames(spark, folder):
    variables, rules, listed = segment_frames(spark, folder, "en")
    assert variables.count() == 3 and rules.count() == 3 and listed.first()["value"] == "Mr."
