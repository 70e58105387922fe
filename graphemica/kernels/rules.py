"""A generic compiler and evaluator for LDML segmentation rules, over variables and rules of any source."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

#: ``$Name``: a letter or underscore, then letters, digits and underscores.
_NAME = re.compile(r"\$([A-Za-z_][A-Za-z0-9_]*)")


@dataclass(frozen=True)
class Rule:
    seq: float
    op: str  # break or no_break
    fore: str | None  # pattern that the text before must end with; None: anything
    aft: str | None  # pattern that the text after must start with


def expand_variables(variables: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Values with earlier variables put in; a later definition may refer to the earlier value of its name."""
    known: dict[str, str] = {}
    for name, value in variables:
        known[name.lstrip("$")] = substitute(value, known)
    return known


def substitute(text: str, known: dict[str, str]) -> str:
    def put(m: re.Match[str]) -> str:
        if m[1] not in known:
            raise ValueError(f"Unknown variable ${m[1]}")
        return known[m[1]]

    return _NAME.sub(put, text)


def _pattern(text: str) -> str:
    """A rule's side as a pattern: spaces don't count, and difference and intersection of sets have two signs."""
    text = re.sub(r"\s+", "", text)
    return re.sub(r"(?<=[\]}])([&-])(?=\[|\\[pP]\{)", r"\1\1", text)


def compile_rule(seq: float, text: str, known: dict[str, str]) -> Rule:
    op = "no_break" if "×" in text else "break"
    if "×" not in text and "÷" not in text:
        raise ValueError(f"A rule needs × or ÷: {text!r}")
    fore, aft = (substitute(side.strip(), known) for side in re.split("[×÷]", text, maxsplit=1))
    return Rule(seq, op, f"(?:{_pattern(fore)})$" if fore.strip() and fore.strip().lower() != "any" else None, f"^(?:{_pattern(aft)})" if aft.strip() and aft.strip().lower() != "any" else None)


#: The place of the rule for abbreviations among the rules for sentences.
SUPPRESSIONS = 10.5


def compile_rules(rules: Sequence[tuple[float, str]], variables: Sequence[tuple[str, str]], suppressions: Sequence[str] = ()) -> list[Rule]:
    """Rules in the order of their ids; with abbreviations, one more rule forbids a break after each of them."""
    known = expand_variables(variables)
    out = [compile_rule(seq, text, known) for seq, text in sorted(rules)]
    if listed := suppressions_variable(suppressions):
        out.append(compile_rule(SUPPRESSIONS, f"{listed[0]}\\s* ×", {listed[0].lstrip("$"): listed[1]}))
        out.sort(key=lambda r: r.seq)
    return out


def suppressions_variable(listed: Sequence[str]) -> tuple[str, str] | None:
    """A variable that matches any listed abbreviation; None without any."""
    return ("$Suppressions", "(" + "|".join(re.escape(s) for s in listed) + ")") if listed else None


def evaluate_rules(text: str | tuple[str, str], rules: Sequence[Rule]) -> tuple[str, tuple[str, tuple[str, str]]]:
    """(op, (before, (matched, rest))) by the first rule that holds; without one there is a break.

    A text alone is looked at from its start.  ``matched`` is what the rule saw after the place.  The rule for
    abbreviations holds at the end of a text as well, and gives back what stands before the abbreviation and the
    abbreviation itself (or that and nothing).
    """
    import regex

    before, after = ("", text) if isinstance(text, str) else text
    flags = regex.VERSION1 | regex.DOTALL | regex.UNICODE
    for rule in rules:
        fore = rule.fore is None or regex.search(rule.fore.removesuffix("$") + r"\Z", before, flags)
        if rule.seq == SUPPRESSIONS and rule.aft is None and rule.fore is not None:
            if fore:
                head, found = before[: fore.start()], before[fore.start() :]
                return rule.op, (before, (head, found) if head else (found, ""))
            continue
        aft = None if rule.aft is None else regex.match(rule.aft, after, flags)
        if fore and (rule.aft is None or aft):
            size = aft.end() if aft else min(1, len(after))
            return rule.op, (before, (after[:size], after[size:]))
    return "break", (before, (after[:1], after[1:]))
