import importlib.metadata
import pathlib
import re
import time

import pytest
from conftest import SMALL

from graphemica.llm import license_scan as s

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL = """it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Foo is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (MIT, [("MIT", "mit-grant+mit-notice+mit-asis")]),
        ("Some words\nAll rights reserved.\nmore", [("all-rights-reserved", "all-rights")]),
        ("Copyright 2019 X. All rights reserved.", [("all-rights-reserved", "copyright+all-rights")]),
        ("Copyright 2019 X. Nothing more.", []),
        ("a. Licensed under the Apache License, Version 2.0. b", [("Apache-2.0", "apache-2")]),
        ("# Licensed under the Apache License,\n# Version 2.0", [("Apache-2.0", "apache-2")]),
        ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0-only", "gpl-3")]),
        ("Released under the MIT licence.", [("MIT", "mit-released")]),
        ("Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", "cc-by-nc-4")]),
        ("// SPDX-License-Identifier: BSD-3-Clause\ncode", [("BSD-3-CLAUSE", "spdx:bsd-3-clause")]),
        ("You may not use this file except in compliance with the License.", [("UNKNOWN", "apache-comply")]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", [("MPL-2.0", "mpl-2")]),
        ("Copyright 2020 Foo, released under the MIT License.", [("MIT", "mit-released")]),
        ("*" * 1300 + " All rights reserved.", [("all-rights-reserved", "all-rights")]),
        ("Copyright 2020 " + "Foo " * 900 + "and others. All rights reserved.", [("all-rights-reserved", "copyright+all-rights")]),
        (APACHE, [("Apache-2.0", "apache-2+apache-comply+apache-copy+apache-asis+apache-see")]),
        (" ".join(APACHE.split()), [("Apache-2.0", "apache-2+apache-comply+apache-copy+apache-asis+apache-see")]),
        ("Foo is free software: you can redistribute it and/or modify\n" + GPL, [("GPL-3.0-or-later", "free-software+gpl-free-3+gpl-hope+gpl-implied+gpl-see+gpl-copy+gpl-address")]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.", [("BSD-2-Clause", "bsd-grant+bsd-source+bsd-binary")]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", [("ISC", "isc-grant")]),
        ("He said the license is fine.", []),
        ("", []),
    ],
)
def test_texts(text, expected):
    assert [m[:2] for m in s.matches(text)] == expected


SYSTEM = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("name", SYSTEM)
def test_whole_licences_are_one_row(name):
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("this system has no copy of the licence")
    text = path.read_text(errors="replace")
    assert [m[0] for m in s.matches(text)] == [SYSTEM[name]]
    assert [m[0] for m in s.matches("A foreword.\n\n" + text.replace("\n", "\n * "))] == [SYSTEM[name]]


def test_installed_licences():
    """The licences that installed packages carry, against what their metadata say."""
    known = {"MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "Apache-2.0": "Apache-2.0"}
    seen = 0
    for dist in importlib.metadata.distributions():
        want = known.get(dist.metadata.get("License-Expression") or "")
        files = [f for f in dist.files or [] if re.fullmatch(r"LICENSE(\.txt|\.md)?", f.name)]
        if want and len(files) == 1:
            assert want in [m[0] for m in s.matches(files[0].locate().read_text(errors="replace"))], dist.name
            seen += 1
    if not seen:
        pytest.skip("no installed package says its licence")


def test_every_known_sentence_has_a_trigger():
    """A sentence without a trigger would be passed over, so each reading's fixed words must hold one."""
    names = set()
    for line in s.SENTENCES.strip().split("\n"):
        name, _, pattern = line.partition(": ")
        names.add(name)
        for words in s._readings(pattern):
            assert re.search(s.TRIGGERS, " ".join(w for w in words if w != "*"), re.I), (name, words)
    assert {k for _, rule in s._ORDERED for k, _ in rule} <= names


def plain(words, start, ends):
    """The longest known sentence from a word on, by trying every reading on every end."""
    best = None
    stop = words.hard_end(start)
    for line in s.SENTENCES.strip().split("\n"):
        name, _, pattern = line.partition(": ")
        for reading in s._readings(pattern):
            form = re.compile("".join(r"(?:(?<!\S)\S+ )*?" if w == "*" else re.escape(w) + " " for w in reading))
            for end in range(start + 1, (stop if "*" in reading else min(start + len(reading), len(words.words))) + 1):
                if (reading[-1] == "*" or end in ends) and form.fullmatch(" ".join(words.words[start:end]) + " "):
                    if reading[-1] == "*":
                        end = words.line_end(start) if name in ("copyright", "spdx") else stop
                    if best is None or end > best[0]:
                        best = (end, name)
    return best


def test_tree_equals_trying_every_reading():
    texts = [MIT, APACHE, GPL, "Copyright 2019 X. All rights reserved.", "Licensed under CC BY 4.0.\nReleased under the MIT License, and more", "neither the name of X nor Y may be used to endorse or promote products derived from this software without prior permission", "In no event shall Z be liable for any special, direct, indirect, or consequential damages of W.\n# SPDX-License-Identifier: MIT\n"]
    seen = 0
    for text in texts:
        words = s.Words(text)
        finder = s._Finder(words)
        for start in words.starts:
            if start < len(words.words):
                ends = {e for e in range(len(words.words) + 1) if finder._may_end(e, 0)}
                want, got = plain(words, start, ends), finder.find(start)
                assert (got and got[0]) == (want and want[0]) and (not got or got[1] == want[1]), (text, start)
                seen += got is not None
    assert seen > 15


def test_time_grows_with_the_text():
    for line in ("neither the name of x and permission is hereby not granted, in no event shall\n", "copyright 2020 a, b, c, d\n"):
        times = []
        for n in (2_000, 8_000):
            began = time.process_time()
            assert s.matches(line * n) == []
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 0.5


def test_query_against_plain_search(spark, duck):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    want = sorted((d, name) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall() for line in t.split("\n") for k, name in lines.items() if line == k)
    assert sorted((r.doc_id, r.license) for r in s.op6_license_scan(spark, SMALL).collect()) == want


def test_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, line, "x"), (3, line, "x"), (None, line, "x"), (4, "a b. " * 200_000 + line, "x"), (5, f"{line}\n{line}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or -1, r.license, r.first_sentence) for r in s.license_scan(df).collect())
    assert got == [(-1, "MIT", 0), (3, "MIT", 0), (3, "MIT", 0), (4, "MIT", 200_000), (5, "MIT", 0), (5, "MIT", 1)]
    assert s.license_scan(df.limit(0)).count() == 0
