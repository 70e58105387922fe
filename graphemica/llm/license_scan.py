"""License scans by sentence rules.

A text becomes words (lower case, plain quotes, no marks around a word, no comment signs or list numbers), and
places where a sentence may begin or end: after a period, colon, semicolon, question or exclamation mark, around
blank lines and line breaks, and after commas.  Known licence sentences are sequences of words, some with a slot
for a name, a year or an address.  They are looked up in a tree of words from every place where a sentence may
begin, and become identifiers.  Ordered rules then match sequences of identifiers, the first rule that fits at the
earliest place first; what it matched is used up.  Identifiers that no rule takes are reported as ``UNKNOWN``.

Plan: a narrow map.  A linear-time regular expression over whole Arrow columns finds the texts that hold any
of the TRIGGERS; every known sentence holds one (a test proves it), so no other text can match.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences as words.  [a|b] is one of several readings (empty: may be left out), * is any words of the
#: same sentence and may be none at its end.  Several lines under one identifier are several readings.
SENTENCES = """
copyright: [portions|] copyright *
all-rights: all rights reserved
mit-title: [the|] mit license [mit|]
mit-released: [this work is|this file is|this program is|this software is|this document is|this project is|] [released|licensed|distributed] under the [terms of the|] mit license *
mit-grant: permission is hereby granted free of charge to any person obtaining a copy of this software *
mit-notice: the above copyright notice and this permission notice [including the next paragraph|] shall be included in all copies or substantial portions of the software
mit-asis: the software is provided as is without warranty of any kind *
mit-liability: in no event shall the authors or copyright holders be liable for any claim *
isc-title: [the|] isc license [isc|isc/l|]
isc-grant: permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc-asis: the software is provided as is and * disclaims all warranties with regard to this software *
isc-liability: in no event shall * be liable for any special direct indirect or consequential damages *
bsd-title: [the|] bsd [2-clause|3-clause|] license
bsd-grant: redistribution and use [in source and binary forms|of this software|] with or without modification are permitted provided that the following conditions are met
bsd-source: redistributions of source code must retain the [above|] copyright notice this list of conditions and the following disclaimer *
bsd-binary: redistributions in binary form must reproduce the [above|] copyright notice this list of conditions and the following disclaimer *
bsd-endorse: neither the name [of|] * may be used to endorse or promote products derived from this software without * permission
bsd-endorse: [the name of the author|the names of its contributors|the name of *] may not be used to endorse or promote products derived from this software without * permission
bsd-asis: this software is provided by * as is and any express or implied warranties *
bsd-liability: in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages *
apache-title: apache license version 2.0 january 2004
apache-2: [this work is|this file is|this program is|this software is|this document is|this project is|] licensed under the [terms of the|] apache license version [2|2.0] [the license|]
apache-comply: you may not use this [file|work|project|software] except in compliance with the license
apache-copy: you may obtain a copy of the license at [http://www.apache.org/licenses/license-2.0|https://www.apache.org/licenses/license-2.0|http://apache.org/licenses/license-2.0|www.apache.org/licenses/license-2.0]
apache-asis: unless required by applicable law or agreed to in writing * distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-see: see the license for the specific language governing permissions and limitations under the license
gpl-title-3: gnu general public license version 3 29 june 2007
gpl-title-2: gnu general public license version 2 june 1991
gpl-title-1: gnu general public license version 1 february 1989
lgpl-title-2.1: gnu lesser general public license version 2.1 february 1999
lgpl-title-2: gnu library general public license version 2 june 1991
lgpl-title-3: gnu lesser general public license version 3 29 june 2007
agpl-title-3: gnu affero general public license version 3 19 november 2007
gpl-3: [this work is|this file is|this program is|this software is|this document is|this project is|] licensed under the gnu general public license version [3|3.0]
gpl-2: [this work is|this file is|this program is|this software is|this document is|this project is|] licensed under the gnu general public license version [2|2.0]
lgpl: [this work is|this file is|this program is|this software is|this document is|this project is|] licensed under the gnu [lesser|library] general public license version [2|2.1|3|3.0]
agpl-3: [this work is|this file is|this program is|this software is|this document is|this project is|] licensed under the gnu affero general public license version [3|3.0]
free-software: [this program|this library|] is free software
gpl-free-3: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-free-2: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-free-1: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
lgpl-free-2: you can redistribute it and/or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-free-2.1: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version
lgpl-free-3: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-free-3: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-hope: [this program|this library|it|] is distributed in the hope that it will be useful but without any warranty
gpl-implied: without even the implied warranty of merchantability or fitness for a particular purpose
gpl-see: see the gnu [lesser|library|affero|] general public license for more details
gpl-copy: you should have received a copy of the gnu [lesser|library|affero|] general public license along with this [program|library] *
gpl-address: if not [see|write to] *
mpl-title: mozilla public license version 2.0
mpl-2: this source code form is subject to the terms of the mozilla public license v [2.0|. 2.0]
mpl-copy: if a copy of the mpl was not distributed with this file you can obtain one at *
epl-title-2: eclipse public license v [2.0|2.0.]
epl-2: this program and the accompanying materials are made available under the terms of the eclipse public license [v|version] 2.0 *
epl-1: this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 *
unlicense-free: this is free and unencumbered software released into the public domain
unlicense-anyone: anyone is free to copy modify publish use compile sell or distribute this software *
zlib-asis: this software is provided as-is without any express or implied warranty
zlib-liability: in no event will the authors be held liable for any damages arising from the use of this software
zlib-grant: permission is granted to anyone to use this software for any purpose including commercial applications *
boost-title: boost software license [version|-] 1.0 *
boost: distributed under the boost software license version 1.0
cc-by-nc-4: [this work is|this file is|this document is|] licensed under [a|the|] [cc by-nc 4.0|creative commons attribution-noncommercial 4.0 international license] *
cc-by-sa-4: [this work is|this file is|this document is|] licensed under [a|the|] [cc by-sa 4.0|creative commons attribution-sharealike 4.0 international license] *
cc-by-4: [this work is|this file is|this document is|] licensed under [a|the|] [cc by 4.0|creative commons attribution 4.0 international license] *
cc0: [this work is|this file is|] [released|dedicated|licensed] [to|under] [the public domain|cc0 1.0] [under cc0 1.0|]
cc0-title: cc0 1.0 universal
spdx: spdx-license-identifier *
"""
#: Licence, then identifiers in order; in brackets those that may be missing.  The first rule that fits wins.
RULES = """
BSD-3-Clause: [bsd-title] [copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-endorse [bsd-asis] [bsd-liability]
BSD-2-Clause: [bsd-title] [copyright] [all-rights] bsd-grant bsd-source bsd-binary [bsd-asis] [bsd-liability]
BSD-1-Clause: [bsd-title] [copyright] [all-rights] bsd-grant bsd-source [bsd-asis] [bsd-liability]
MIT: [mit-title] [copyright] [all-rights] mit-grant mit-notice [mit-asis] [mit-liability]
MIT: mit-released
MIT: mit-title
ISC: [isc-title] [copyright] [all-rights] isc-grant [isc-asis] [isc-liability]
ISC: isc-title
Apache-2.0: [copyright] [all-rights] apache-2 [apache-comply] [apache-copy] [apache-asis] [apache-see]
Apache-2.0: apache-title
GPL-3.0-or-later: [copyright] [free-software] gpl-free-3 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
GPL-2.0-or-later: [copyright] [free-software] gpl-free-2 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
GPL-1.0-or-later: [copyright] [free-software] gpl-free-1 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
LGPL-2.0-or-later: [copyright] [free-software] lgpl-free-2 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
LGPL-2.1-or-later: [copyright] [free-software] lgpl-free-2.1 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
LGPL-3.0-or-later: [copyright] [free-software] lgpl-free-3 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
AGPL-3.0-or-later: [copyright] [free-software] agpl-free-3 [gpl-hope] [gpl-implied] [gpl-see] [gpl-copy] [gpl-address]
GPL-3.0: gpl-title-3 [copyright]
GPL-2.0: gpl-title-2 [copyright]
GPL-1.0: gpl-title-1 [copyright]
LGPL-2.1: lgpl-title-2.1 [copyright]
LGPL-2.0: lgpl-title-2 [copyright]
LGPL-3.0: lgpl-title-3 [copyright]
AGPL-3.0: agpl-title-3 [copyright]
GPL-3.0-only: gpl-3
GPL-2.0-only: gpl-2
AGPL-3.0-only: agpl-3
LGPL: lgpl
MPL-2.0: mpl-2 [mpl-copy]
MPL-2.0: mpl-title
EPL-2.0: epl-2
EPL-1.0: epl-1
EPL-2.0: epl-title-2
Unlicense: unlicense-free [unlicense-anyone]
Zlib: [copyright] zlib-asis zlib-liability [zlib-grant]
BSL-1.0: boost
BSL-1.0: boost-title
CC-BY-NC-4.0: cc-by-nc-4
CC-BY-SA-4.0: cc-by-sa-4
CC-BY-4.0: cc-by-4
CC0-1.0: cc0
CC0-1.0: cc0-title
all-rights-reserved: copyright all-rights
all-rights-reserved: all-rights
"""
#: A licence's own text begins with its title and repeats its notice as an example; identifiers that say nothing alone.
_SILENT = frozenset({"copyright", "free-software", "bsd-title", "gpl-address", "gpl-implied", "gpl-see", "zlib-asis", "apache-see"})
#: Every known sentence holds one of these.
TRIGGERS = r"licen[sc]e|copyright|©|\([cC]\)|rights\s+reserved|redistribut|warrant|as[ -]is|permission|permitted|public\s+domain|liable|useful|free\s+software|endorse|free\s+to\s+copy|if\s+not|if\s+a\s+copy|accompanying\s+materials|cc0"
_TRIGGER = re.compile(TRIGGERS, re.I)
_PLAIN = str.maketrans({"“": '"', "”": '"', "’": "'", "‘": "'", " ": " "})
_LINE_MARK = re.compile(r"^[ \t]*(?:#+|//+|\*+|--+|;+|>+|dnl\b|rem\b|%+|\"+)?[ \t]*", re.M)
_WORD = re.compile(r"\S+|\n")
_AROUND = "\"'`()[]{}<>,;:.!?*#|_=~\\/-"
_LIST_MARK = re.compile(r"\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]|[-*•o·]")
#: Words whose period ends no sentence.
_SHORT = frozenset({"v", "inc", "no", "st", "e.g", "i.e", "co", "corp", "ltd", "jr", "dr", "mr", "vol", "sec", "art"})
_MATCHES = "doc_id long, license string, sentence_ids string, first_sentence long, n_sentences long"
_MATCHES_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("sentence_ids", pa.string()), ("first_sentence", pa.int64()), ("n_sentences", pa.int64())])


#: Beginnings of known sentences that need no mark before them; before the last two stands the name of a program.
_INNER = {("unless", "required", "by"), ("you", "may", "not"), ("all", "rights", "reserved"), ("is", "free", "software"), ("is", "distributed", "in")}
_INNER_WORDS = {x[0] for x in _INNER}


class Words:
    """The normalised words of a text, and by word number where sentences may begin and end."""

    def __init__(self, text: str):
        text = _LINE_MARK.sub("", text.lower().translate(_PLAIN).replace("licence", "license").replace("©", " copyright "))
        self.words: list[str] = []
        hard, soft, commas, blank = {0}, {0}, set(), 0
        for m in _WORD.finditer(text):
            raw, n = m[0], len(self.words)
            if raw == "\n":
                blank += 1
                soft.add(n)
                if blank > 1:
                    hard.add(n)
                continue
            blank = 0
            if (n in hard or n in soft) and _LIST_MARK.fullmatch(raw):
                hard.add(n)  # an item of a list is a sentence of its own
                continue
            word = "copyright" if raw == "(c)" else raw.strip(_AROUND)
            if not word:
                continue
            if word == "copyright" and n and self.words[-1] == word and n not in hard:
                continue
            self.words.append(word)
            end = raw.rstrip("\"'`)]}>*_")[-1:]
            if word == "spdx-license-identifier":
                continue
            if end in ("!", "?", ";", ":") or (end == "." and word not in _SHORT):
                hard.add(n + 1)
            elif end == ",":
                commas.add(n + 1)
        n = len(self.words)
        self.hard, self.soft, self.commas = sorted(x for x in hard | {n} if x <= n), sorted(x for x in soft if x <= n), sorted(commas)
        self.starts = sorted(hard | soft | commas)
        self.ends = hard | soft | {n}

    def hard_end(self, at: int) -> int:
        """Where the sentence that holds word ``at`` must end."""
        return self.hard[min(bisect_right(self.hard, at), len(self.hard) - 1)]

    def line_end(self, at: int) -> int:
        k = bisect_right(self.soft, at)
        return min(self.hard_end(at), self.soft[k] if k < len(self.soft) else len(self.words))


def _readings(pattern: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for part in re.findall(r"\[[^\]]*\]|\S+", pattern):
        options = [o.split() for o in part[1:-1].split("|")] if part[0] == "[" and len(part) > 1 else [[part]]
        out = [[*o, *x] for o in out for x in options]
    return out


def _tree() -> dict:
    """Word -> the tree of what may follow; "" -> the identifier that ends here."""
    root: dict = {}
    for line in SENTENCES.strip().split("\n"):
        name, _, pattern = line.partition(": ")
        for words in _readings(pattern):
            at = root
            for w in words:
                at = at.setdefault(w, {})
            at.setdefault("", name)
    return root


_ROOT = _tree()


class _Finder:
    """Known sentences of one text.  A slot takes as few words as it can; the next place of a word after a slot is
    remembered while it lies ahead, so a text is walked once per slot however often a sentence seems to begin."""

    def __init__(self, text: Words):
        self.text = text
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(text.words):
            self.at.setdefault(w, []).append(i)
        self.slots: dict[tuple[int, int], tuple[int, tuple[int, str] | None]] = {}

    def find(self, start: int) -> tuple[int, str] | None:
        """(end, identifier) of the longest known sentence from word ``start``."""
        if start >= len(self.text.words):
            return None
        return self._walk(_ROOT, start, start, self.text.hard_end(start))

    def _walk(self, tree: dict, at: int, start: int, stop: int) -> tuple[int, str] | None:
        best = None
        words = self.text.words
        while True:
            if "*" in tree and (at > start or tree is not _ROOT):
                best = max(filter(None, (best, self._slot(tree["*"], at, start, stop))), default=None)
            if "" in tree and self._may_end(at, stop):
                best = max(filter(None, (best, (at, tree[""]))), default=None)
            if at >= len(words) or words[at] not in tree:
                return best
            tree = tree[words[at]]
            at += 1

    def _may_end(self, at: int, stop: int) -> bool:
        return at in self.text.ends or self._goes_on(at)

    def _goes_on(self, at: int) -> bool:
        """Whether the fixed beginning of a known sentence stands here, where no mark need be before it."""
        return tuple(self.text.words[at : at + 3]) in _INNER

    def _slot(self, tree: dict, at: int, start: int, stop: int) -> tuple[int, str] | None:
        """``tree`` after any words of this sentence."""
        key = (id(tree), stop)
        if key in self.slots and (known := self.slots[key])[0] >= at:
            found = known[1]
        else:
            found, place = None, stop
            for w in tree:
                if w in ("", "*"):
                    continue
                places = self.at.get(w, ())
                i = bisect_left(places, at)
                while i < len(places) and places[i] < stop:
                    if got := self._walk(tree, places[i], start, stop):
                        if found is None or got > found:
                            found, place = got, places[i]
                        break
                    i += 1
            self.slots[key] = (place, found)
        if "" in tree:
            end = self.text.line_end(start) if tree[""] in ("copyright", "spdx") else stop
            found = max(filter(None, (found, (end, tree[""]))), default=None) if end >= at else found
        return found


def sentences(text: str) -> tuple[list[tuple[int, int, str]], Words]:
    """(first word, end, identifier) of the known sentences of a text, in order."""
    words = Words(text)
    finder, found, at = _Finder(words), [], 0
    extra = {i for i, w in enumerate(words.words) if w in _INNER_WORDS and finder._goes_on(i)}
    within = sorted({*words.commas, *extra})
    for start in sorted({*words.starts, *extra}):
        if start < at or not (got := finder.find(start)):
            continue
        end, name = got
        if name == "copyright":  # what else is said in its line stands on its own
            inner = within[bisect_right(within, start) : bisect_left(within, end)]
            end = next((s for s in inner if (x := finder.find(s)) and x[1] not in ("copyright", "free-software")), end)
        elif words.words[start] == "is":
            start = max(at, words.hard[bisect_right(words.hard, start) - 1])
        elif name == "spdx":
            name = f"spdx:{words.words[start + 1]}" if end > start + 1 else ""
            end = min(end, start + 2)
        if name:
            found.append((start, end, name))
            at = end
    return found, words


def _rules() -> list[tuple[str, list[tuple[str, bool]]]]:
    out = []
    for line in RULES.strip().split("\n"):
        name, _, ids = line.partition(": ")
        out.append((name, [(x.strip("[]"), x[0] != "[") for x in ids.split()]))
    return out


_ORDERED = _rules()


def _fit(rule: list[tuple[str, bool]], ids: list[str], at: int, stop: int) -> int:
    """How many identifiers from ``at`` the rule takes, or 0."""
    i = at
    for name, needed in rule:
        if i < stop and ids[i] == name:
            i += 1
        elif needed:
            return 0
    return i - at


def matches(text: str) -> list[tuple[str, str, int, int]]:
    """(licence, identifiers, first sentence, sentences) in the order of the text."""
    if not _TRIGGER.search(text):
        return []
    found, words = sentences(text)
    edges = sorted({*words.hard, *(a for a, _, _ in found), *(b for _, b, _ in found)})
    known: list[tuple[int, int, str]] = []
    for a, b, name in found:  # copyright lines that follow each other are one statement
        if name == "copyright" and known and known[-1][1:] == (a, name):
            a = known.pop()[0]
        known.append((a, b, name))
    found, ids = known, [name for _, _, name in known]
    stops = list(range(1, len(found) + 1))  # where other words come between
    for k in range(len(found) - 2, -1, -1):
        if found[k][1] == found[k + 1][0]:
            stops[k] = stops[k + 1]
    out, i, titled = [], 0, ""
    while i < len(found):
        for name, rule in _ORDERED:
            if size := _fit(rule, ids, i, stops[i]):
                break
        else:
            size, name = 1, "UNKNOWN"
            if ids[i].startswith("spdx:"):
                name = ids[i].removeprefix("spdx:").upper()
            elif ids[i] in _SILENT:
                name = ""
        family = re.sub(r"-\d.*$", "", name)
        if name and not (titled and (name == "UNKNOWN" or family == titled)):
            own = i  # whose copyright it is says nothing of the licence
            while name != "all-rights-reserved" and own < i + size - 1 and ids[own] in ("copyright", "all-rights"):
                own += 1
            out.append((name, "+".join(ids[own : i + size]), bisect_left(edges, found[own][0]), i + size - own))
        if any("-title" in x for x in ids[i : i + size]) and len(words.words) > found[i][1] + 800:
            titled = family  # the licence's own text: its notice, given as an example, is no second statement
        elif name not in ("", "UNKNOWN", "all-rights-reserved") and family != titled:
            titled = ""
        i += size
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = pc.fill_null(pc.match_substring_regex(batch.column(1), TRIGGERS, ignore_case=True), False)
        some = batch.filter(hit)
        rows = [(doc, *m) for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for m in matches(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MATCHES_ARROW.types, strict=True)], schema=_MATCHES_ARROW)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence statements in documents: doc_id, license, sentence_ids (joined by +), first_sentence (from 0), n_sentences.

    A row for every match, so none for documents without one.  A copyright line alone is no licence; a licence's
    own text is one statement, with the notice that it gives as an example.  Defined cases: null and empty texts
    match nothing; very long texts are read whole, in time proportional to their length; where several known
    sentences begin at one place the longest counts, and of several rules the first; repeated statements and
    repeated rows are reported each; null ids are reported as null; an empty table gives no rows.  Other columns
    are ignored, whatever their names.
    """
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_scan, _MATCHES)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
