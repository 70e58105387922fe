"""Boundary kernels: a text becomes a string of class letters, and rules run over that small alphabet.

Graphemes and words are regular languages over classes, so one possessive pattern finds all segments in one
pass.  Sentences look only at terminators.  Line breaks follow the rule table of ``line``.  All are linear in the
text, and all give their segments one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from graphemica.kernels.dictionary import Dictionary, greedy_word, lookahead_breaks
from graphemica.kernels.locales import check_break, dictionary_of, segmentation_locale
from graphemica.kernels.line import line_break, line_ends
from graphemica.kernels.properties import ClassTable, class_table, dictionary_script, marks

_GRAPHEME = re.compile(
    rb"rn|[rnc]|p*+(?:L*+(?:[AV]V*+T*+|BT*+)|L++|T++|RR?|X(?:[ekE]*+zX)*+|C(?:[ez]*+k[ezk]*+C)*+|[^rncp])?[ekEzs]*+"
)


def _word_pattern() -> re.Pattern[bytes]:
    t = rb"[ez]*+"  # transparent: Extend, Format, ZWJ
    element = rb"(?:[aA]T(?:[mbq]T(?=[ahA]))?+|hT(?:dT(?=h)|[mbq]T(?=[ahA])|(?!q))|0T(?:[ubq]T(?=0))?+)"
    final = rb"hTqT"  # a Hebrew letter keeps a quote that leads nowhere
    run = rb"(?:(?:kT)++|E++)"
    low = rb"(?:_T)++"
    word = rb"(?:(?:Y)?+Z)*+(?:(?:kT)++|E++(?:F)?+|F)|(?:(?:Y)?+Z)++"
    unit = rb"(?:rn|[rnN]|(?:w++T|W|RT(?:RT)?+|[^rnN]T))"
    out = rb"U(?:(?<=z)(?=[XA])U)*+"
    for name, part in ((b"U", unit), (b"W", rb"(?:" + word + rb")"), (b"Y", run), (b"Z", low), (b"F", final), (b"E", element)):
        out = out.replace(name, part) if name != b"E" else re.sub(rb"E(?=\+\+)", lambda _: part, out)
    return re.compile(out.replace(b"T", t), re.S)


_WORD = _word_pattern()
_TERMINATED = re.compile(rb"[at]e*+((?:xe*+)*+)((?:se*+)*+)(rn|[rnp])?|rn|[rnp]")
_DECISIVE = re.compile(rb"[lOurnpat]")


class Classifier:
    """Class letters of a text, from a table that is spread out on first use."""

    def __init__(self, table: ClassTable):
        self.table = table
        self._flat: np.ndarray | None = None

    def __call__(self, text: str) -> bytes:
        if self._flat is None:
            self._flat = self.table.spread()
        return self._flat[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tobytes()

    def __getstate__(self):
        return {"table": self.table, "_flat": None}


def grapheme_ends(classes: bytes) -> Iterator[int]:
    return (m.end() for m in _GRAPHEME.finditer(classes) if m.end() > m.start())


def word_ends(classes: bytes) -> Iterator[int]:
    return (m.end() for m in _WORD.finditer(classes))


def _suppressed(text: str, classes: bytes, start: int, end: int, words: frozenset[str]) -> bool:
    """Whether the segment's last word before its final ATerm is an abbreviation of the locale."""
    i = end
    while i > start and classes[i - 1] in b"rnpsxe":
        i -= 1
    if i == start or classes[i - 1] != 97:  # ATerm
        return False
    j = i - 1
    while j > start and classes[j - 1] in b"ulO0e":
        j -= 1
    return j < i - 1 and text[j : i - 1].lower() in words


def sentence_ends(text: str, classes: bytes, words: frozenset[str] = frozenset()) -> Iterator[int]:
    start, at, n = 0, 0, len(classes)
    while at < n:
        m = _TERMINATED.search(classes, at)
        if not m:
            break
        end, head = m.end(), classes[m.start()]
        at = end
        if m[3] or head in b"rnp":  # a separator ends the sentence, whatever follows
            yield end
            start = end
            continue
        if end == n:
            break
        following = classes[end]
        if following in b"cta":
            continue
        if head == 97:  # ATerm
            if not m[1] and not m[2]:
                if following == 48:
                    continue
                before = next((classes[i] for i in range(m.start() - 1, start - 1, -1) if classes[i] != 101), 0)
                if following == 117 and before in b"ul":
                    continue
            decisive = _DECISIVE.search(classes, end)
            if decisive and decisive[0] == b"l":
                continue
            if words and _suppressed(text, classes, start, end, words):
                continue
        yield end
        start = end
    if start < n:
        yield n


# ---- one break type in one locale

_LINE_SCRIPTS = (("th", "[\u0e01-\u0e5b]"), ("lo", "[\u0e81-\u0edf]"), ("my", "[\u1000-\u109f]"), ("km", "[\u1780-\u17ff]"))
_RUNS = {k: re.compile(f"{r}{{4,}}") for k, r in _LINE_SCRIPTS}
_BLOCKS = {k: re.compile(f"({r}+)") for k, r in _LINE_SCRIPTS}
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Segmenter:
    """Segments of one break type in one locale, as plain Python.  Pickles small; tables spread on first use."""

    def __init__(self, break_type: str = "word", locale: str | None = None, suppressions: bool = True, words: frozenset[str] = frozenset(), dictionaries: dict[str, Dictionary] | None = None):
        self.break_type = check_break(break_type)
        self.locale = segmentation_locale(break_type, locale)
        self.classify = Classifier(class_table(break_type, "el" if self.locale == "el" else "root"))
        self.words = words if suppressions and break_type == "sentence" else frozenset()
        self.dictionaries = dictionaries or {}
        self.dictionary = dictionary_of(locale) if break_type == "word" else None
        self.marks = Classifier(marks())
        self.script = Classifier(dictionary_script(self.dictionary)) if self.dictionary else None

    def loaded(self, name: str | None) -> Dictionary | None:
        found = self.dictionaries.get(name) if name else None
        return found if found and found.available() else None

    def boundaries(self, text: str) -> Iterator[int]:
        """Ends of the segments that the rules alone give, one after the other."""
        classes = self.classify(text)
        if self.break_type == "grapheme":
            return grapheme_ends(classes)
        if self.break_type == "word":
            return word_ends(classes)
        if self.break_type == "sentence":
            return sentence_ends(text, classes, self.words)
        return line_ends(classes)

    def ends(self, text: str) -> list[int]:
        return list(self.boundaries(text))

    def _rules(self, text: str) -> Iterator[str]:
        at = 0
        for end in self.boundaries(text):
            yield text[at:end]
            at = end

    def _greedy(self, text: str, dictionary: Dictionary) -> Iterator[str]:
        """Dictionary runs word by word, the rest by rules, cut before the next dictionary run."""
        inside, mark = self.script(text), self.marks(text)
        at, n = 0, len(text)
        while at < n:
            if inside[at]:
                end = greedy_word(text, at, inside, mark, dictionary)
                yield text[at:end]
                at = end
                continue
            stop = inside.find(1, at)
            stop = n if stop < 0 else stop
            # the rules see the run's first character, and what they would join with it is cut; later ones change nothing
            head = at
            for end in self.boundaries(text[at : stop + 1]):
                end = min(at + end, stop)
                yield text[head:end]
                head = end
                if end == stop:
                    break
            at = stop

    def _lookahead(self, text: str, name: str, dictionary: Dictionary, rest) -> Iterator[str]:
        """Runs of a script by the dictionary with look-ahead, everything else by ``rest``."""
        for i, part in enumerate(_BLOCKS[name].split(text)):
            if not part:
                continue
            if i % 2 == 0:
                yield from rest(part)
            elif len(part) < 4:
                yield part
            else:
                cuts = [0, *lookahead_breaks(part, name, dictionary, self.marks(part)), len(part)]
                yield from (part[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def walk(self, text: str | None) -> Iterator[str]:
        """Segments one after the other (``next`` until the end); each is found when it is asked for."""
        if not text:
            return iter(())
        if dictionary := self.loaded(self.dictionary):
            return self._greedy(text, dictionary)
        return self._rules(text)

    def stream(self, text: str | None) -> list[str] | None:
        return None if text is None else list(self.walk(text))

    def split(self, text: str | None) -> list[str] | None:
        """All segments.  Differs from ``stream`` for Thai, Lao, Khmer and Burmese words and for lines."""
        if not text:
            return self.stream(text)
        if self.break_type == "word" and self.dictionary in _BLOCKS and (dictionary := self.loaded(self.dictionary)):
            return list(self._lookahead(text, self.dictionary, dictionary, lambda part: self._greedy(part, dictionary)))
        if self.break_type == "line":
            return [word for segment in self._rules(text) for word in self._line_words(segment)]
        return self.stream(text)

    def _line_words(self, segment: str) -> list[str]:
        name = next((k for k, r in _RUNS.items() if r.search(segment)), None) if not segment.isascii() else None
        dictionary = self.loaded(name)
        if not dictionary:
            return [segment]
        out: list[str] = []
        for part in self._lookahead(segment, name, dictionary, lambda rest: [rest]):
            if out and _WHITE.fullmatch(part):
                out[-1] += part
            else:
                out.append(part)
        return out

    def next(self, text: str | None, trim: bool = False) -> tuple[str, str] | None:
        """(first segment, rest); with ``trim`` the first that isn't white space.  None at the end."""
        at = 0
        for segment in self.walk(text):
            at += len(segment)
            if not (trim and is_white(segment)):
                return segment, text[at:]
        return None

    def is_break(self, before: str, after: str) -> bool:
        """Whether the rules (never a dictionary) put a boundary between the two."""
        if not before or not after:
            return True
        if self.break_type == "sentence":
            return _sentence_break(self, before, after)
        if self.break_type == "word":
            return len(before) in word_ends(self.classify(before + after))
        if self.break_type == "grapheme":
            return len(before) in grapheme_ends(self.classify(before + after[:1]))
        return line_break(self.classify(before + after), len(before))


def _sentence_break(seg: Segmenter, before: str, after: str) -> bool:
    classes = seg.classify(before)
    ends = list(sentence_ends(before, classes, seg.words))
    start = ([0, *ends[:-1]])[-1]
    if ends and ends[-1] == len(before) and classes[-1] in b"rnp":
        # the last sentence of ``before`` has ended by a separator
        return not (classes[-1] == 114 and after[0] == "\n")
    part = before[start:]
    whole = part + after
    return len(part) in sentence_ends(whole, seg.classify(whole), seg.words)


def is_white(text: str) -> bool:
    return bool(text) and _WHITE.fullmatch(text) is not None
