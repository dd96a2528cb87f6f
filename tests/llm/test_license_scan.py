import re

from proofline.llm import license_scan as L

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""


def brute(text):
    """Sentences one by one, rules by scanning the sequence."""
    found = []
    for wrapped in (False, True):
        counts = {}
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        parts = re.split(r"[.!?;:]+(?:[\x20\x09-\x0d]+|\Z)|" + (r"\n[^a-z0-9\n]*\n" if wrapped else "\n"), low)
        sentences = [s for s in (re.sub("[^a-z0-9]+", " ", p).strip(" ") for p in parts) if s]
        back = {s: n for n, s in L.SENTENCES.items()}
        seq = []
        for i, s in enumerate(sentences):
            if s in back:
                if seq and i - last > L.GAP + 1:
                    seq.append(None)
                seq.append(back[s])
                last = i
        for k, (_, _, rule) in enumerate(L.RULES):
            i, n = 0, 0
            while i + len(rule) <= len(seq):
                if tuple(seq[i : i + len(rule)]) == rule:
                    seq[i : i + len(rule)] = ["#"]
                    n += 1
                i += 1
            counts[L.RULES[k][0]] = counts.get(L.RULES[k][0], 0) + n
        found.append(counts)
    best = {name: max(c[name] for c in found) for name in found[0]}
    return sorted(name for name, n in best.items() if n), sum(best.values())


def test_against_brute_force(spark):
    far = "Released under the MIT License.\n" + "Word here. " * 9 + "\nAll rights reserved."
    texts = [None, "", "  \n", "x", MIT, BSD, MIT + BSD, BSD.replace("2. R", "* R"), "Title\nReleased under the MIT License.\nmore", "All  Rights\tReserved!! all rights reserved", "Licensed under\nthe Apache License, Version 2.0.", "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-only\nmit", far, "mit. mit. mit", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("Licensed under CC BY-NC 4.0. " * 3 + "é" * 50 + ". ") * 2000, "unreleased under the MIT License.", "\x01all rights reserved"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(4, MIT, 5)], "doc_id long, text string, MATCHES int")
    got = L.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute((r.text or "").replace("\x01", " . "))
        assert (r.licenses, sum(m.n for m in r.matches)) == want, (r.doc_id, r.licenses, want)
    by = {r.doc_id: r.licenses for r in got}
    assert by[4] == ["MIT"] and by[5] == ["BSD-2-Clause"] and by[10] == ["Apache-2.0"] and by[12] == ["GPL-3.0-only"] and by[17] == []
    assert L.scan(df.limit(0)).count() == 0


GRANT = MIT.split("\n\n", 2)[2].replace("copies or substantial portions of the Software.\n", "copies or substantial portions of the Software.") + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details."""


def test_texts_as_they_stand_in_files(spark):
    """Expectations by hand: each text counts as one licence, in a file of its own and in comments of three kinds."""
    texts = {"MIT": GRANT, "ISC": ISC, "MPL-2.0": MPL, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL}
    head = "Copyright (c) 2020 Foo"
    rows = []
    for name, text in texts.items():
        for lead in ("", "# ", "// ", " * "):
            lines = [lead + line for line in [head, "", *text.split("\n"), "", "import os"]]
            rows.append((name, lead, "\n".join(line.rstrip() for line in lines)))
    df = spark.createDataFrame(rows, "want string, lead string, text string")
    for r in L.scan(df).collect():
        assert r.licenses == [r.want] and sum(m.n for m in r.matches) == 1 and r.sentences, (r.want, r.lead, r.matches)


def test_one_licence_in_two_readings_counts_once(spark):
    wrapped = MIT.replace("included in all\ncopies", "included in all copies").replace("\n", " ", 0)
    one_line = " ".join(GRANT.split("\n\n")[0].split()) + "\n\n" + GRANT.split("\n\n")[1]
    df = spark.createDataFrame([(1, one_line), (2, " ".join(GRANT.split())), (3, wrapped)], "doc_id int, text string")
    assert {r.doc_id: [m.n for m in r.matches] for r in L.scan(df).collect()} == {1: [1], 2: [1], 3: [1]}


BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL {who} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
THIRD = """3. Neither the name of {} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
#: Written by hand: what a reader would say that a text is under.
BY_HAND = [
    ("Copyright (c) 1990 The Regents of the University of Somewhere.\nAll rights reserved.\n\n" + BSD_BODY.format(third=THIRD.format("the University"), who="THE REGENTS AND CONTRIBUTORS"), {"BSD-3-Clause"}),
    ("Copyright 2011 Some Person. All rights reserved.\n" + BSD_BODY.format(third="", who="SOME PERSON"), {"BSD-2-Clause"}),
    ("Copyright (c) 2020, Example Inc.\n\n" + BSD_BODY.format(third=THIRD.format("Example Inc."), who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), {"BSD-3-Clause"}),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n", {"GPL-3.0-only"}),
    ("  GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n", {"LGPL-2.1-only"}),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", {"Apache-2.0"}),
    ("# SPDX-License-Identifier: BSD-2-Clause\nimport os\n", {"BSD-2-Clause"}),
    ("/* SPDX-License-Identifier: GPL-2.0-only */\n", {"GPL-2.0-only"}),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", {"MIT", "Apache-2.0"}),
    ("// SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR MPL-2.0\n", {"MIT", "BSD-3-Clause", "MPL-2.0"}),
    ("# SPDX-License-Identifier: ISC\n", {"ISC"}),
    ("MIT License\n\nCopyright (c) 2020 Foo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n", {"MIT"}),
    ("Copyright 2021 Big Corp. All rights reserved. Do not copy.", {"LicenseRef-all-rights-reserved"}),
    ("All rights reserved.\n" + "Some other line.\n" * 9 + "Released under the MIT License.", {"LicenseRef-all-rights-reserved", "MIT"}),
    ("mit or apache 2.0 were mentioned in a talk about the name of the rose", set()),
    ("Neither the name of the wind nor the sound of rain.", set()),
    ("in no event shall anyone be late", set()),
]


def test_licences_read_by_hand(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BY_HAND)], "doc_id long, text string")
    got = {r.doc_id: set(r.licenses) for r in L.scan(docs).collect()}
    for i, (text, want) in enumerate(BY_HAND):
        assert got[i] == want, text[:120]
