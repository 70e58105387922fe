"""Line break opportunities: the rules of Unicode Standard Annex 14 as a table, run by an automaton.

A rule has what stands before a place, × (no break) or ÷ (break), and what stands after it; the first rule that
fits decides, and without one there is a break.  The parts before are sequences of class sets, and all of them are
followed at once: a state is the set of places in the rules that the text so far has reached.  States and steps are
made when they are first needed and remembered, so the text is walked once, at a look-up per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from graphemica.kernels.properties import LINE

# The rules in the annex's order and notation.  | separates classes, ~ is any other class, * is any number of,
# ^ is the beginning of the segment.  A rule in brackets [] looks at the characters one by one; in all others CM and ZWJ are
# part of what they follow, or AL if that is a hard break, a space, ZW or nothing.  Hangul is JL|JV|JT|H2|H3.
RULES = """
LB4    BK ÷
LB5    [CR × LF]
LB5    CR|LF|NL ÷
LB6    × BK|CR|LF|NL
LB7    × SP|ZW
LB8    ZW SP* ÷
LB8a   [ZWJ ×]
LB9    ~BK|CR|LF|NL|SP|ZW × CM|ZWJ
LB11   × WJ
LB11   WJ ×
LB12   GL ×
LB12a  ~SP|BA|HY × GL
LB14   OP SP* ×
LB15   QU SP* × OP
LB16   CL|CP SP* × NS
LB17   B2 SP* × B2
LB15c  SP ÷ IS NU
LB15d  × IS
LB13   × CL|CP|EX|SY
LB18   SP ÷
LB19   × QU
LB19   QU ×
LB20   ÷ CB
LB20   CB ÷
LB20a  ^ HY × AL|HL
LB20a  BK|CR|LF|NL|SP|ZW|CB|GL HY × AL|HL
LB21   × BA|HY|NS|IN
LB21   BB ×
LB21a  HL HY|BA ×
LB21b  SY × HL
LB23   AL|HL × NU
LB23   NU × AL|HL
LB23a  PR × ID|EB|EM
LB23a  ID|EB|EM × PO
LB24   PR|PO × AL|HL
LB24   AL|HL × PR|PO
LB25   CL|CP|NU × PR|PO
LB25   PR|PO|NU × OP
LB25   PR|PO|HY|IS|NU|SY|CP × NU
LB26   JL × JL|JV|H2|H3
LB26   JV|H2 × JV|JT
LB26   JT|H3 × JT
LB27   JL|JV|JT|H2|H3 × PO
LB27   PR × JL|JV|JT|H2|H3
LB28   AL|HL × AL|HL
LB29   IS × AL|HL
LB30   AL|HL|NU × OP
LB30   CP × AL|HL
LB30a  [^ RI × RI]
LB30a  [~RI RI × RI]
LB30b  EB × EM
"""

_N = {name: i for i, name in enumerate(LINE)}
_MARKS = frozenset({_N["CM"], _N["ZWJ"]})
_BARE = frozenset(_N[x] for x in ("BK", "CR", "LF", "NL", "SP", "ZW"))
_ALL = frozenset(range(len(LINE)))


def _classes(item: str) -> frozenset[int]:
    some = frozenset(_N[x] for x in item.strip("~*").split("|"))
    return _ALL - some if item[0] == "~" else some


class _Rule:
    def __init__(self, text: str):
        self.bare = text.startswith("[")
        text = text.strip("[] ")
        self.joined = "×" in text
        before, after = (x.split() for x in text.replace("÷", "×").split("×"))
        self.anchored = before[:1] == ["^"]
        before = before[self.anchored :]
        self.before = [_classes(x) for x in before]
        self.loops = [x.endswith("*") for x in before]
        self.after = [_classes(x) for x in after]

    def reached(self, places: set[int]) -> set[int]:
        """With the places behind items that may be left out."""
        out = set(places)
        for p in range(len(self.before)):
            if p in out and self.loops[p]:
                out.add(p + 1)
        return out

    def step(self, places: set[int], c: int) -> set[int]:
        return {p if self.loops[p] else p + 1 for p in self.reached(places) if p < len(self.before) and c in self.before[p]}

    def fits(self, c: int, ahead: int) -> bool:
        return (not self.after or c in self.after[0]) and (len(self.after) < 2 or ahead in self.after[1])


_RULES = [_Rule(line.split(None, 1)[1]) for line in RULES.strip().split("\n")]
_AHEAD = frozenset(c for r in _RULES if len(r.after) > 1 for c in r.after[0])


class Automaton:
    """States by number; ``START`` stands before the first character of a segment."""

    START = 0

    def __init__(self):
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.decisions: dict[tuple[int, int, int], tuple[bool, int]] = {}
        self._number((None, tuple((0,) for _ in _RULES)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def step(self, state: int, c: int) -> int:
        """The state after one more character."""
        if (state, c) not in self.steps:
            last, places = self.states[state]
            mark = c in _MARKS
            part = mark and last is not None and last not in _BARE
            seen = _N["AL"] if mark else c
            out = []
            for rule, own in zip(_RULES, places, strict=True):
                begin = set() if rule.anchored else {0}
                if rule.bare:
                    new = rule.step(set(own), c) | begin
                elif part:  # what is reached stays reached
                    new = set(own)
                else:
                    new = rule.step(set(own), seen) | begin
                    if mark:  # a mark after spaces leaves the spaces open
                        new |= {p for p in rule.reached(set(own)) if p < len(rule.before) and rule.loops[p]}
                out.append(tuple(sorted(new)))
            self.steps[state, c] = self._number((last if part else seen, tuple(out)))
        return self.steps[state, c]

    def joined(self, state: int, c: int, ahead: int = -1) -> bool:
        """Whether there is no break before class ``c``; ``ahead`` is the class after it, past CM and ZWJ."""
        for rule, own in zip(_RULES, self.states[state][1], strict=True):
            if len(rule.before) in rule.reached(set(own)) and rule.fits(c, ahead):
                return rule.joined
        return False

    def decide(self, state: int, c: int, ahead: int) -> tuple[bool, int]:
        """(no break before ``c``, the state after it)."""
        key = (state, c, ahead)
        if key not in self.decisions:
            joined = self.joined(state, c, ahead)
            self.decisions[key] = (joined, self.step(state if joined else self.START, c))
        return self.decisions[key]


_AUTOMATON = Automaton()
_RUN = re.compile(rb"(.)\1*", re.S)


def ahead_of(classes: bytes, at: int) -> int:
    """The class after place ``at``, past CM and ZWJ, where a rule asks for it."""
    if classes[at] not in _AHEAD:
        return -1
    at += 1
    while at < len(classes) and classes[at] in _MARKS:
        at += 1
    return classes[at] if at < len(classes) else -1


def line_ends(classes: bytes) -> Iterator[int]:
    """Ends of the segments between break opportunities, one after the other."""
    if not classes:
        return
    known, auto = _AUTOMATON.decisions, _AUTOMATON
    state = auto.step(auto.START, classes[0])
    for m in _RUN.finditer(classes):
        i, end = m.span()
        c = classes[i]
        asks = c in _AHEAD
        i += i == 0
        while i < end:
            ahead = ahead_of(classes, i) if asks else -1
            joined, new = known.get((state, c, ahead)) or auto.decide(state, c, ahead)
            if not joined:
                yield i
            elif new == state and not asks:
                break  # the rest of the run changes nothing
            state = new
            i += 1
    yield len(classes)


def line_break(classes: bytes, at: int) -> bool:
    """Whether there is a break opportunity at one place, by all that stands before it."""
    auto = _AUTOMATON
    state = auto.START
    for c in classes[:at]:
        state = auto.step(state, c)
    return not auto.joined(state, classes[at], ahead_of(classes, at))
