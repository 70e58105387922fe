"""Locale resolution: exact tag, else its language, else the default."""

from __future__ import annotations

import re

# Locales with segmentation data, dictionaries and casing rules.
SEGMENTATION_LOCALES = ("de", "el", "en", "en-US", "en-US-POSIX", "es", "fi", "fr", "it", "ja", "pt", "root", "ru", "sv", "zh", "zh-Hant")
DICTIONARY_LOCALES = ("zh", "th", "lo", "my", "km", "ja", "zh-Hant", "zh-Hant-HK", "yue", "yue-Hant", "yue-Hans")
CASING_LOCALES = ("az", "el", "lt", "nl", "tr")
BREAKS = ("grapheme", "word", "line", "sentence")


def check_break(break_type: str) -> str:
    if break_type not in BREAKS:
        raise ValueError(f"Unknown break {break_type!r}. Valid breaks are {', '.join(BREAKS)}")
    return break_type


def _match(locale: str | None, known: tuple[str, ...], default: str | None) -> str | None:
    if not locale:
        return default
    tag = locale.replace("_", "-")
    if tag in known:
        return tag
    language = re.split("[-_]", locale, maxsplit=1)[0]
    return language if language in known else default


def unknown_locale_error(locale: str) -> str:
    return f"Unknown locale {locale!r}"


def casing_locale(locale: str | None = None) -> str:
    return _match(locale, CASING_LOCALES, "any")


def dictionary_locale(locale: str | None = None) -> str | None:
    return _match(locale, DICTIONARY_LOCALES, None)


def segmentation_locale(break_type: str = "word", locale: str | None = None) -> str:
    """For words a dictionary locale comes first; other breaks never see one."""
    check_break(break_type)
    return (dictionary_locale(locale) if break_type == "word" else None) or _match(locale, SEGMENTATION_LOCALES, "root")


def dictionary_of(locale: str | None) -> str | None:
    """The dictionary of a dictionary locale: Chinese, Cantonese and Japanese share one."""
    found = dictionary_locale(locale)
    if found is None:
        return None
    language = found.split("-")[0]
    return "zh" if language in ("zh", "yue", "ja") else language


def special_casing_locales() -> list[str]:
    return list(CASING_LOCALES)


def known_segmentation_locales() -> list[str]:
    return list(SEGMENTATION_LOCALES)


def known_dictionary_locales() -> list[str]:
    return list(DICTIONARY_LOCALES)


def ancestors(locale: str) -> list[str]:
    """``en-US-POSIX`` -> itself, ``en-US``, ``en``, ``root``."""
    tag = locale.replace("_", "-")
    if tag not in SEGMENTATION_LOCALES:
        raise ValueError(unknown_locale_error(locale))
    parts = tag.split("-")
    chain = ["-".join(parts[:i]) for i in range(len(parts), 0, -1)]
    return list(dict.fromkeys([*(c for c in chain if c in SEGMENTATION_LOCALES), "root"]))


def is_language(tag: str | None) -> bool:
    return tag is not None and len(tag.encode()) in (2, 3)


def is_script(tag: str | None) -> bool:
    return tag is not None and len(tag.encode()) == 4


def is_territory(tag: str | None) -> bool:
    return tag is not None and len(tag.encode()) == 2
