"""Case folding and locale-aware case mapping of plain strings.

Full mappings come from Python's Unicode tables.  Two properties are part of the defined results: a locale's
rules hold up to the first non-ASCII character that has no rule of its own in that locale, and from there on
the general rules hold; a sigma is final if it is the last cased character of the whole string and not the
first.  ``strict=True`` keeps a locale's rules throughout.
"""

from __future__ import annotations

import functools
import unicodedata

from graphemica.kernels.locales import casing_locale

_DOT = "\u0307"
#: Marks that Greek upper case drops, from any letter, and the iota subscript.
_GREEK_MARKS = frozenset("\u0313\u0314\u0301\u0300\u0306\u0342\u0308\u0304\u0345")
_TURKIC = ("tr", "az")
#: Lithuanian letters that keep their dot under an accent: lower case, and whether an accent must follow.
_LITHUANIAN = {"I": ("i\u0307", True), "J": ("j\u0307", True), "\u012e": ("\u012f\u0307", True), "\u00cc": ("i\u0307\u0300", False), "\u00cd": ("i\u0307\u0301", False), "\u0128": ("i\u0307\u0303", False)}


@functools.lru_cache(1)
def _cased():
    import regex

    return regex.compile(r"\p{Cased}")


@functools.lru_cache(1)
def _above():
    import regex

    return regex.compile(r"\p{ccc=230}")


def is_turkic(mode: str | None) -> bool:
    return mode is not None and (mode == "turkic" or mode.replace("_", "-").split("-")[0] in _TURKIC)


def fold(text: str | None, mode: str | None = None) -> str | None:
    """Full case folding; with ``turkic`` (or tr, az) dotted and dotless i stay apart.  No normalisation."""
    if text is None:
        return None
    if is_turkic(mode):
        text = text.replace("\u0130", "i").replace("I", "\u0131")
    return text.casefold()


def equals_ignoring_case(a: str | None, b: str | None, mode: str | None = None) -> bool | None:
    return None if a is None or b is None else fold(a, mode) == fold(b, mode)


def _general_lower(text: str) -> str:
    if "\u03a3" not in text:
        return text.lower()
    last = text.rindex("\u03a3")
    plain = text.replace("\u03a3", "\u03c3")
    if _cased().search(text, 0, last) and not _cased().search(text, last + 1):
        return plain[:last].lower() + "\u03c2" + plain[last + 1 :].lower()
    return plain.lower()


def _split_at_foreign(text: str, own: str, strict: bool) -> int:
    """Where the locale's rules end: the first non-ASCII character without a rule of its own."""
    if strict or text.isascii():
        return len(text)
    return next((i for i, c in enumerate(text) if not c.isascii() and c not in own), len(text))


def upcase(text: str | None, locale: str | None = None, strict: bool = False) -> str | None:
    if not text:
        return text
    where = casing_locale(locale)
    if where == "el":
        kept = "".join(c for c in unicodedata.normalize("NFD", text) if c not in _GREEK_MARKS)
        return unicodedata.normalize("NFC", kept).upper()
    if where in _TURKIC:
        end = _split_at_foreign(text, "", strict)
        return text[:end].replace("i", "\u0130").upper() + text[end:].upper()
    return text.upper()


def downcase(text: str | None, locale: str | None = None, strict: bool = False) -> str | None:
    if not text:
        return text
    where = casing_locale(locale)
    if where in _TURKIC:
        end = _split_at_foreign(text, "\u0130", strict)
        head = text[:end].replace("\u0130", "i").replace("I", "\u0131")
        return _lower_parts(head, text[end:], text, end)
    if where == "lt":
        end = _split_at_foreign(text, "".join(_LITHUANIAN), strict)
        out = []
        for i, c in enumerate(text[:end]):
            lower, needs = _LITHUANIAN.get(c, (c, False))
            out.append(lower if not needs or _above().search(text, i + 1) else c.lower())
        return _lower_parts("".join(out), text[end:], text, end)
    return _general_lower(text)


def _lower_parts(head: str, tail: str, text: str, end: int) -> str:
    """The head has its own rules applied; a final sigma in the tail looks at the whole text."""
    if "\u03a3" not in text[end:]:
        return head.lower() + tail.lower()
    whole = _general_lower(text[:end] + tail)
    return head.lower() + whole[len(text[:end].replace("\u03a3", "\u03c3").lower()) :]


def title_word(word: str, locale: str | None = None) -> str:
    """One word: its first character in title case, the rest in lower case, seen alone."""
    if not word:
        return word
    where = casing_locale(locale)
    if where == "nl" and word[:2].lower() == "ij":
        return "IJ" + _general_lower(word[2:])
    first = "\u0130" if where in _TURKIC and word[0] == "i" else word[0].title()
    return first + (downcase(word[1:], where) or "")
