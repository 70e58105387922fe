import pytest

from graphemica.kernels import casing as c
from graphemica.kernels import locales as loc

#: Accents go in Greek upper case, and so do diaereses.
GREEK = "άνθρωπος, ήλιος, ΐ ϋ ώρα: Ὦ ἄλφα"


@pytest.mark.parametrize(
    ("f", "locale", "text", "expected"),
    [
        (c.upcase, None, "Ὀδυσσεύς", "ὈΔΥΣΣΕΎΣ"), (c.title_word, None, "ὈΔΥΣΣΕΎΣ", "Ὀδυσσεύς"), (c.downcase, None, "ὈΔΥΣΣΕΎΣ", "ὀδυσσεύς"),
        (c.upcase, "el", GREEK, "ΑΝΘΡΩΠΟΣ, ΗΛΙΟΣ, Ι Υ ΩΡΑ: Ω ΑΛΦΑ"),
        (c.upcase, "tr", "ii", "İİ"), (c.upcase, "az", "ii", "İİ"), (c.upcase, None, "ii", "II"), (c.upcase, "tr", "Diyarbakır", "DİYARBAKIR"),
        (c.downcase, "tr", "DİYARBAKIR", "diyarbakır"), (c.title_word, "nl", "ijthings", "IJthings"), (c.title_word, "nl", "ijsselmeer", "IJsselmeer"),
        (c.title_word, None, "island", "Island"), (c.title_word, "tr", "island", "İsland"), (c.title_word, "az", "island", "İsland"),
        (c.downcase, None, "ΣΑ", "σα"), (c.downcase, None, "ΟΔΟΣ ΑΒ", "οδοσ αβ"), (c.downcase, None, "ΟΔΟΣ", "οδος"), (c.title_word, None, "ΑΣ", "Ασ"),
        (c.downcase, "lt", "Ì", "i̇̀"), (c.upcase, "lt", "i̇", "İ"), (c.upcase, "lt", "i̇̀", "İ̀"),
        (c.downcase, "tr", "İ", "ı̇"), (c.downcase, "tr", "̇I", "̇i"),
        (c.upcase, None, "123 xyz!", "123 XYZ!"), (c.downcase, None, "123!ABC", "123!abc"), (c.upcase, None, "straße", "STRASSE"), (c.upcase, "el", "é", "E"),
    ],
)
def test_case(f, locale, text, expected):
    assert f(text, locale) == expected


def test_locale_rules_end_at_a_foreign_character():
    assert c.upcase("iéi", "tr") == "İÉI"
    assert c.upcase("iéi", "tr", strict=True) == "İÉİ"


def test_fold():
    assert [c.fold(x) for x in ("Weiß", "grüßen", "I", "ς", None)] == ["weiss", "grüssen", "i", "σ", None]
    assert c.fold("İ", "turkic") == "i" and c.fold("I", "tr") == "ı" and c.fold("I", "az-Latn") == "ı"
    assert c.equals_ignoring_case("beißen", "beissen") and not c.equals_ignoring_case("grüßen", "grussen")
    assert c.equals_ignoring_case(None, "a") is None


def test_contexts():
    """Final sigma, dots of Lithuanian letters before accents above, and soft dots."""
    assert [c.downcase(x) for x in ("ΣΟΦΟΣ", "Σ", "ΣΟΦΟΣ.", "Α Σ", "ΑΣ1")] == ["σοφος", "σ", "σοφος.", "α ς", "ας1"]
    assert c.downcase("J\u0301", "lt") == "j\u0307\u0301" and c.downcase("Ja", "lt") == "ja" and c.downcase("Í", "lt") == "i\u0307\u0301"
    assert c.downcase("I", "az") == "ı" and c.upcase("ı", "tr") == "I"


def test_errors():
    assert loc.unknown_locale_error("xx") == "Unknown locale 'xx'"
    with pytest.raises(ValueError, match="Unknown break 'paragraph'"):
        loc.check_break("paragraph")


def test_locales():
    assert [loc.segmentation_locale("word", x) for x in ("fr", "en", "ar")] == ["fr", "en", "root"]
    assert [loc.casing_locale(x) for x in ("az", "tr", "lt", "en", "ar")] == ["az", "tr", "lt", "any", "any"]
    assert loc.ancestors("en-US") == ["en-US", "en", "root"] and loc.ancestors("en-US-POSIX")[0] == "en-US-POSIX"
    assert loc.segmentation_locale("word", "zh_Hant_HK") == "zh-Hant-HK" and loc.segmentation_locale("line", "th") == "root"
    assert loc.dictionary_of("yue_Hans") == "zh" and loc.dictionary_of("zh-Hans") == "zh" and loc.dictionary_of("en") is None
    assert loc.special_casing_locales() == ["az", "el", "lt", "nl", "tr"] and len(loc.known_dictionary_locales()) == 11
    assert loc.is_language("en") and loc.is_script("Latn") and loc.is_territory("GB") and not loc.is_script("en")
    with pytest.raises(ValueError):
        loc.ancestors("xx")
