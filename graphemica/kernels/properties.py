"""Character classes for segmentation, built by rule from the Unicode properties of the ``regex`` module.

A class table gives every code point one byte.  It is built once on the driver, travels as runs (a few KB)
and is spread out to a flat array once per Python worker.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np

LAST = 0x110000

#: Break type -> (letter, property pattern) in order; later entries override earlier ones.  Anything else: ``o``.
_CLASSES: dict[str, tuple[tuple[str, str], ...]] = {
    "grapheme": (
        ("X", r"\p{Extended_Pictographic}"), ("C", r"\p{InCB=Consonant}"),
        ("r", r"\p{GCB=CR}"), ("n", r"\p{GCB=LF}"), ("c", r"\p{GCB=Control}"), ("L", r"\p{GCB=L}"), ("V", r"\p{GCB=V}"), ("T", r"\p{GCB=T}"),
        ("A", r"\p{GCB=LV}"), ("B", r"\p{GCB=LVT}"), ("E", r"\p{GCB=Extend}"), ("z", r"\p{GCB=ZWJ}"), ("s", r"\p{GCB=SpacingMark}"),
        ("p", r"\p{GCB=Prepend}"), ("R", r"\p{GCB=Regional_Indicator}"), ("e", r"[\p{GCB=Extend}&&\p{InCB=Extend}]"), ("k", r"\p{InCB=Linker}"),
    ),
    "word": (
        ("X", r"\p{Extended_Pictographic}"), ("a", r"\p{WB=ALetter}"), ("A", r"[\p{WB=ALetter}&&\p{Extended_Pictographic}]"), ("h", r"\p{WB=Hebrew_Letter}"),
        ("r", r"\p{WB=CR}"), ("n", r"\p{WB=LF}"), ("N", r"\p{WB=Newline}"), ("e", r"[\p{WB=Extend}\p{WB=Format}]"), ("z", r"\p{WB=ZWJ}"), ("w", r"\p{WB=WSegSpace}"),
        ("m", r"\p{WB=MidLetter}"), ("u", r"\p{WB=MidNum}"), ("b", r"\p{WB=MidNumLet}"), ("q", r"\p{WB=Single_Quote}"), ("d", r"\p{WB=Double_Quote}"),
        ("0", r"\p{WB=Numeric}"), ("k", r"\p{WB=Katakana}"), ("_", r"\p{WB=ExtendNumLet}"), ("R", r"\p{WB=Regional_Indicator}"),
    ),
    "sentence": (
        ("r", r"\p{SB=CR}"), ("n", r"\p{SB=LF}"), ("p", r"\p{SB=Sep}"), ("e", r"[\p{SB=Extend}\p{SB=Format}]"), ("s", r"\p{SB=Sp}"), ("l", r"\p{SB=Lower}"), ("u", r"\p{SB=Upper}"),
        ("O", r"\p{SB=OLetter}"), ("0", r"\p{SB=Numeric}"), ("a", r"\p{SB=ATerm}"), ("c", r"\p{SB=SContinue}"), ("t", r"\p{SB=STerm}"), ("x", r"\p{SB=Close}"),
    ),
}

#: Line classes by number; AI, SG, XX and SA are AL, CJ is NS, HH is HY.
LINE = ("AL", "BK", "CR", "LF", "NL", "SP", "ZW", "CM", "ZWJ", "WJ", "GL", "OP", "QU", "CL", "CP", "NS", "B2", "IS", "NU", "EX", "SY", "CB", "HY", "HL", "BA", "BB", "IN", "PR", "ID", "EB", "EM", "PO", "JL", "JV", "JT", "H2", "H3", "RI")
_LINE_PATTERNS = {"NS": r"[\p{LB=NS}\p{LB=CJ}]", "HY": r"[\p{LB=HY}\p{LB=HH}]"}
#: Classes that have no rule of their own here and behave as letters.
_LINE_OTHER = frozenset({"AK", "AP", "AS", "VF", "VI"})


@dataclass(frozen=True)
class ClassTable:
    starts: bytes
    letters: bytes

    def spread(self) -> np.ndarray:
        """One byte for each code point."""
        starts = np.frombuffer(zlib.decompress(self.starts), dtype=np.uint32)
        letters = np.frombuffer(zlib.decompress(self.letters), dtype=np.uint8)
        return np.repeat(letters, np.diff(starts, append=np.uint32(LAST)))


@functools.lru_cache(None)
def _all_characters() -> str:
    return "".join(map(chr, range(LAST)))


def members(pattern: str) -> np.ndarray:
    """One flag for each code point."""
    import regex

    out = np.zeros(LAST, dtype=bool)
    for m in regex.finditer(f"(?V1){pattern}+", _all_characters()):
        out[m.start() : m.end()] = True
    return out


@functools.lru_cache(None)
def class_table(break_type: str, locale: str = "root") -> ClassTable:
    if break_type == "line":
        flat = np.zeros(LAST, dtype=np.uint8)
        for i, name in enumerate(LINE):
            if name != "AL":
                flat[members(_LINE_PATTERNS.get(name, rf"\p{{LB={name}}}"))] = i
    else:
        flat = np.full(LAST, ord("o"), dtype=np.uint8)
        for letter, pattern in _CLASSES[break_type]:
            flat[members(pattern)] = ord(letter)
        if break_type == "sentence" and locale == "el":  # the Greek question mark and the semicolon end sentences
            flat[[0x3B, 0x37E]] = ord("t")
    starts = np.flatnonzero(np.diff(flat, prepend=255)).astype(np.uint32)
    return ClassTable(zlib.compress(starts.tobytes()), zlib.compress(flat[starts].tobytes()))


@functools.lru_cache(None)
def marks() -> ClassTable:
    """1 for general categories Mn, Mc and Me."""
    return _flags(r"\p{M}")


def _flags(pattern: str) -> ClassTable:
    flat = members(pattern).astype(np.uint8)
    starts = np.flatnonzero(np.diff(flat, prepend=255)).astype(np.uint32)
    return ClassTable(zlib.compress(starts.tobytes()), zlib.compress(flat[starts].tobytes()))


@functools.lru_cache(None)
def dictionary_script(dictionary: str) -> ClassTable:
    """1 for the characters that a dictionary covers."""
    script = {"th": "Thai", "lo": "Lao", "km": "Khmer", "my": "Myanmar"}
    if dictionary == "zh":
        return _flags(r"[\p{Han}\p{Hiragana}\p{Katakana}\u30fc\uff70\uff9e\uff9f]")
    return _flags(rf"[\p{{{script[dictionary]}}}&&\p{{LB=SA}}]")
