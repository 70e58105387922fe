"""Dictionary words for Chinese, Japanese, Thai, Lao, Khmer and Burmese.

Words come from the break dictionaries inside the ICU library that Spark ships (byte and character tries), or
from a text file with one word per line.  A dictionary is read on first use, once per Python worker.
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile
from collections.abc import Iterable, Iterator

#: ICU's names, and the code point that byte tries count from.
_FILES = {"zh": ("cjdict", 0), "th": ("thaidict", 0x0E00), "lo": ("laodict", 0x0E80), "km": ("khmerdict", 0x1780), "my": ("burmesedict", 0x1000)}
_FOLDER = "com/ibm/icu/impl/data/icudata/brkitr/"


def icu_jar() -> str | None:
    """ICU among Spark's jars: beside pyspark, or under SPARK_HOME."""
    places = [os.environ.get("SPARK_HOME", "")]
    try:
        import pyspark

        places.append(os.path.dirname(pyspark.__file__))
    except ImportError:
        pass
    found = [p for place in places if place for p in sorted(glob.glob(os.path.join(place, "jars", "icu4j-[0-9]*.jar")))]
    return found[-1] if found else None


class _Trie:
    """Reads ICU's serialized tries: units are bytes or 16-bit characters, with the same three kinds of node."""

    def __init__(self, data: bytes, wide: bool):
        self.wide = wide
        self.units = struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]) if wide else data

    def words(self) -> Iterator[list[int]]:
        todo = [(0, [])]
        while todo:
            at, word = todo.pop()
            yield from self._node(at, word, todo)

    def _node(self, at: int, word: list[int], todo: list) -> Iterator[list[int]]:
        u, wide = self.units, self.wide
        while True:
            lead = u[at]
            at += 1
            if wide:
                if lead >= 0x40 and not lead & 0x8000:  # an intermediate value before a node
                    yield list(word)
                    at += 0 if lead < 0x4040 else 1 if lead < 0x7FC0 else 2
                    lead &= 0x3F
                elif lead & 0x8000:  # a final value
                    yield list(word)
                    return
                if lead < 0x30:
                    self._branch(at, lead, word, todo)
                    return
                n = lead - 0x30 + 1
            else:
                if lead >= 0x20:
                    yield list(word)
                    if lead & 1:
                        return
                    at += self._extra(lead >> 1)
                    continue
                if lead < 0x10:
                    self._branch(at, lead, word, todo)
                    return
                n = lead - 0x10 + 1
            word = [*word, *u[at : at + n]]
            at += n

    @staticmethod
    def _extra(lead: int) -> int:
        """Bytes after the lead byte of a value."""
        return 0 if lead < 0x51 else 1 if lead < 0x6C else 2 if lead < 0x7E else 3 if lead == 0x7E else 4

    def _value(self, at: int) -> tuple[bool, int, int]:
        """(final, value, place after it) of a branch entry."""
        u = self.units
        lead = u[at]
        at += 1
        if self.wide:
            final, v = bool(lead & 0x8000), lead & 0x7FFF
            if v < 0x4000:
                return final, v, at
            if v < 0x7FFF:
                return final, ((v - 0x4000) << 16) | u[at], at + 1
            return final, (u[at] << 16) | u[at + 1], at + 2
        final, v = bool(lead & 1), lead >> 1
        if v < 0x51:
            return final, v - 0x10, at
        if v < 0x6C:
            return final, ((v - 0x51) << 8) | u[at], at + 1
        if v < 0x7E:
            return final, ((v - 0x6C) << 16) | (u[at] << 8) | u[at + 1], at + 2
        size = 3 if v == 0x7E else 4
        return final, int.from_bytes(bytes(u[at : at + size]), "big"), at + size

    def _jump(self, at: int) -> tuple[int, int]:
        """(target, place after the jump)."""
        u = self.units
        d = u[at]
        at += 1
        if self.wide:
            if d >= 0xFC00:
                if d == 0xFFFF:
                    d, at = (u[at] << 16) | u[at + 1], at + 2
                else:
                    d, at = ((d - 0xFC00) << 16) | u[at], at + 1
            return at + d, at
        if d < 0xC0:
            pass
        elif d < 0xF0:
            d, at = ((d - 0xC0) << 8) | u[at], at + 1
        elif d < 0xFE:
            d, at = ((d - 0xF0) << 16) | (u[at] << 8) | u[at + 1], at + 2
        else:
            size = 3 if d == 0xFE else 4
            d, at = int.from_bytes(bytes(u[at : at + size]), "big"), at + size
        return at + d, at

    def _branch(self, at: int, lead: int, word: list[int], todo: list) -> None:
        u = self.units
        if lead == 0:
            lead = u[at]
            at += 1
        parts = [(at, lead + 1)]
        while parts:
            at, n = parts.pop()
            while n > 5:  # a binary search: smaller units elsewhere, the others here
                at += 1
                target, at = self._jump(at)
                parts.append((target, n >> 1))
                n -= n >> 1
            for _ in range(n - 1):
                unit = u[at]
                final, value, at = self._value(at + 1)
                if final:
                    todo.append((None, [*word, unit]))
                else:
                    todo.append((at + value, [*word, unit]))
            todo.append((at + 1, [*word, u[at]]))


def icu_words(name: str, jar: str | None = None) -> Iterator[str]:
    """All words of ICU's dictionary for zh, th, lo, km or my."""
    jar = jar or icu_jar()
    if jar is None:
        raise FileNotFoundError("no icu4j jar among Spark's jars")
    file, base = _FILES[name]
    with zipfile.ZipFile(jar) as z:
        data = z.read(f"{_FOLDER}{file}.dict")
    head = struct.unpack(">H", data[:2])[0]
    offsets = struct.unpack(">8i", data[head : head + 32])
    body = data[head + offsets[0] :]
    trie = _Trie(body, wide=not base)
    todo: list = [(0, [])]
    while todo:
        at, word = todo.pop()
        for found in [word] if at is None else trie._node(at, word, todo):
            if base:
                yield "".join("\u200d" if c == 0xFF else "\u200c" if c == 0xFE else chr(base + c) for c in found)
            else:
                yield struct.pack(f"<{len(found)}H", *found).decode("utf-16-le")


def parse_lines(lines: Iterable[str]) -> Iterator[str]:
    """Words of a text dictionary: ``word`` or ``word<TAB>number``; comments and empty lines are skipped."""
    for line in lines:
        word = line.split("\t")[0].strip().lstrip("\ufeff")
        if word and not word.startswith("#"):
            yield word


_loaded: dict[tuple[str, str | None], dict[str, bool]] = {}


class Dictionary:
    """Words and their prefixes; pickles as a name and a path, and reads on first use in each process."""

    def __init__(self, name: str, path: str | None = None):
        self.name, self.path = name, path

    def _table(self) -> dict[str, bool]:
        key = (self.name, self.path)
        if key not in _loaded:
            try:
                if self.path is None:
                    words = list(icu_words(self.name))
                else:
                    with open(self.path, encoding="utf-8") as f:
                        words = list(parse_lines(f))
            except OSError:
                words = []
            table: dict[str, bool] = {}
            for w in words:
                for i in range(1, len(w)):
                    table.setdefault(w[:i], False)
                table[w] = True
            _loaded[key] = table
        return _loaded[key]

    def available(self) -> bool:
        return bool(self._table())

    def find(self, text: str) -> bool | None:
        """True: a word; False: the beginning of one; None: neither."""
        return self._table().get(text)

    def __contains__(self, word: str) -> bool:
        return self.find(word) is True


def greedy_word(text: str, start: int, inside: bytes, mark: bytes, dictionary: Dictionary) -> int:
    """End of the longest word from ``start`` whose beginnings are all known; at least one character."""
    find, n = dictionary._table().get, len(text)
    best = at = start + 1
    while at < n and inside[at]:
        found = find(text[start : at + 1])
        if found is None:
            break
        at += 1
        if found:
            while at < n and mark[at]:
                at += 1
            best = at
    return best


# Where words of a script may begin and end.
_BEGIN = {
    "th": ((0x0E01, 0x0E2E), (0x0E40, 0x0E44)), "lo": ((0x0E81, 0x0EAE), (0x0EDC, 0x0EDD), (0x0EC0, 0x0EC4)),
    "km": ((0x1780, 0x17B3),), "my": ((0x1000, 0x102A),),
}
_END = {
    "th": (((0x0E01, 0x0E3A),), ((0x0E31, 0x0E31), (0x0E40, 0x0E44))), "lo": (((0x0E81, 0x0EDF),), ((0x0EC0, 0x0EC4),)),
    "km": (((0x1780, 0x17FF),), ((0x17D2, 0x17D2),)), "my": (((0x1000, 0x109F),), ()),
}
_PAIYANNOI, _MAIYAMOK = "\u0e2f", "\u0e46"


def _within(c: str, ranges) -> bool:
    return any(a <= ord(c) <= b for a, b in ranges)


def lookahead_breaks(text: str, name: str, dictionary: Dictionary, mark: bytes) -> list[int]:
    """Word breaks inside a run of one script, choosing among words by the two words that follow."""
    find, n = dictionary._table().get, len(text)
    cache: dict[int, list[int]] = {}

    def words_at(at: int) -> list[int]:
        """Lengths of the words that start here, ascending."""
        if at not in cache:
            out, end = [], at + 1
            while end <= n:
                found = find(text[at:end])
                if found is None:
                    break
                if found:
                    out.append(end - at)
                end += 1
            cache[at] = out
        return cache[at]

    def choose(at: int, sizes: list[int]) -> int:
        best = None
        for size in reversed(sizes):
            second = at + size
            if second >= n:
                return size
            follow = words_at(second)
            if not follow:
                best = None
            elif any(second + w >= n or words_at(second + w) for w in follow):
                return size
            else:
                best = size
        return best or sizes[-1]

    def resumes(at: int) -> bool:
        ends, but = _END[name]
        return _within(text[at - 1], ends) and not _within(text[at - 1], but) and _within(text[at], _BEGIN[name]) and bool(words_at(at))

    out, at = [], 0
    while at < n:
        sizes = words_at(at)
        size = 0 if not sizes else sizes[0] if len(sizes) == 1 else choose(at, sizes)
        end = at + size
        if end < n and size < 3 and not words_at(end):
            here = end + 1
            while here < n and not resumes(here):
                here += 1
            end = min(here, n)
        while end < n and mark[end]:
            end += 1
        if name == "th" and at < end < n and not words_at(end):
            c, p = text[end], text[end - 1]
            if (c == _PAIYANNOI and p not in (_PAIYANNOI, _MAIYAMOK)) or (c == _MAIYAMOK and p != _MAIYAMOK):
                end += 1
        at = max(end, at + 1)
        if end < n:
            out.append(at)
    return out
