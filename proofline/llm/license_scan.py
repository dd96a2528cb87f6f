"""Licence scans by sentence rules.

Sentences are normalised (ASCII lower case, runs of other characters as one space) and mapped to the identifiers of
known licence sentences. The identifiers, in order, form a document's sequence; up to ``GAP`` unknown sentences may
stand between neighbours (list numbers, names, years). Ordered rules, longer sequences first, are matched against it;
a match uses up its sentences, so a part of a licence does not count again as a shorter rule.

Texts are read in two ways, since licences come wrapped as well as line by line: with a line end as a sentence end,
and with only punctuation and lines without ASCII letters and digits as such (so the empty lines of comments end
sentences too). Each licence is counted in the reading that finds it more often, the wrapped one where both agree, so
what both readings find counts once.

Sentences that name an owner are templates (``SLOTS``): who stands in the slot does not matter. An SPDX expression is read
operand by operand. "All rights reserved" counts only where no licence is next to it, since copyright lines above
permissive licences say so too.

DataFrame functions only, in one pass over the texts and without a shuffle. Defined cases: null, empty and blank texts
hold nothing; repeated rows are scanned one by one; an empty table gives an empty result; columns of the input that
clash with the results' are replaced; a character U+0001 ends a sentence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.quality_rules import let

GAP = 4

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache_short": "licensed under the apache license version 2 0",
    "apache_head": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_short": "licensed under the gnu general public license version 3",
    "gpl2_short": "licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "bsd_head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit_liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_obtain": "you may obtain a copy of the license at",
    "apache_url": "http www apache org licenses license 2 0",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd_provided": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd_event": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "gpl3_only_terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2_only_terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl_free": "this library is free software",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_event": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_head": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl2_v": "this source code form is subject to the terms of the mozilla public license v",
    "two_zero": "2 0",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc_by_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by_nd": "licensed under cc by nd 4 0",
    "cc0": "licensed under cc0 1 0",
    "spdx": "spdx license identifier",
    "name_mit": "mit",
    "name_apache": "apache 2 0",
    "name_gpl3": "gpl 3 0 only",
    "name_gpl3_later": "gpl 3 0 or later",
    "name_bsd3": "bsd 3 clause",
    "reserved": "all rights reserved",
    "apache_title": "apache license",
    "apache_dated": "version 2 0 january 2004",
    "gpl_title": "gnu general public license",
    "gpl3_dated": "version 3 29 june 2007",
    "gpl2_dated": "version 2 june 1991",
    "lgpl_title": "gnu lesser general public license",
    "lgpl21_dated": "version 2 1 february 1999",
    "agpl_title": "gnu affero general public license",
    "agpl3_dated": "version 3 19 november 2007",
    "mit_title": "mit license",
    "mpl2_title": "mozilla public license version 2 0",
    "bsd_event_full": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "name_bsd2": "bsd 2 clause",
    "name_gpl2": "gpl 2 0 only",
    "name_gpl2_later": "gpl 2 0 or later",
    "name_lgpl21": "lgpl 2 1 only",
    "name_lgpl21_later": "lgpl 2 1 or later",
    "name_lgpl3": "lgpl 3 0 only",
    "name_lgpl3_later": "lgpl 3 0 or later",
    "name_agpl3": "agpl 3 0 only",
    "name_agpl3_later": "agpl 3 0 or later",
    "name_mpl2": "mpl 2 0",
    "name_isc": "isc",
    "name_zlib": "zlib",
    "name_bsl": "bsl 1 0",
    "name_epl2": "epl 2 0",
    "name_unlicense": "unlicense",
    "name_cc0": "cc0 1 0",
    "name_cc_by": "cc by 4 0",
    "name_cc_by_sa": "cc by sa 4 0",
}
#: Sentences with a slot for the owner's name: how they begin, how they go on after the slot, and the
#: identifier they stand for.
SLOTS = (
    ("neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("neither the name of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("the name of ", " may not be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("this software is provided by ", " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd_provided"),
    ("in no event shall ", " be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services", "bsd_event"),
    ("in no event shall ", " be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd_event_full"),
)
#: Fixed value: the rest of a sentence whose owner's name ends in a full stop, which stands for the whole of it.
AFTER_STOP = ("nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names")
#: Words of a slot's name at most, as characters.
SLOT = 200
#: Operands of an SPDX expression beyond the first that are read.
OPERANDS = 4
_SPDX = "spdx-license-identifier:"
#: Licence, class and sequence of sentences; earlier rules win. The last is that of ``reserved``.
RULES = (
    ("BSD-3-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary", "bsd_names", "bsd_provided", "bsd_event")),
    ("BSD-3-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary", "bsd_names", "bsd_provided", "bsd_event_full")),
    ("BSD-2-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary", "bsd_provided", "bsd_event_full")),
    ("BSD-3-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary", "bsd_names")),
    ("Apache-2.0", "permissive", ("apache_head", "apache_comply", "apache_obtain", "apache_url", "apache_unless", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_head", "apache_comply", "apache_copy", "apache_unless", "apache_see")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free", "gpl3_terms", "gpl_hope", "gpl_even", "gpl_see", "gpl_received")),
    ("GPL-2.0-or-later", "copyleft", ("gpl_free", "gpl2_terms", "gpl_hope", "gpl_even", "gpl_see", "gpl_received")),
    ("BSD-2-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary", "bsd_provided", "bsd_event")),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "mit_as_is", "mit_liable")),
    ("BSD-2-Clause", "permissive", ("bsd_head", "bsd_source", "bsd_binary")),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "mit_as_is")),
    ("Apache-2.0", "permissive", ("apache_head", "apache_comply", "apache_see")),
    ("Zlib", "permissive", ("zlib_as_is", "zlib_event", "zlib_grant")),
    ("MPL-2.0", "copyleft", ("mpl2_v", "two_zero", "mpl2_copy")),
    ("Unlicense", "permissive", ("unlicense", "unlicense_anyone")),
    ("ISC", "permissive", ("isc_grant", "isc_as_is")),
    ("GPL-3.0-only", "copyleft", ("gpl_free", "gpl3_only_terms")),
    ("GPL-2.0-only", "copyleft", ("gpl_free", "gpl2_only_terms")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl_free", "lgpl21_terms")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl_free", "lgpl3_terms")),
    ("AGPL-3.0-or-later", "copyleft", ("gpl_free", "agpl3_terms")),
    ("MPL-2.0", "copyleft", ("mpl2_v", "two_zero")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("Apache-2.0", "permissive", ("apache_head", "apache_comply")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free", "gpl3_terms")),
    ("GPL-2.0-or-later", "copyleft", ("gpl_free", "gpl2_terms")),
    *((license, kind, ("spdx", name)) for name, license, kind in (
        ("name_bsd2", "BSD-2-Clause", "permissive"), ("name_gpl2", "GPL-2.0-only", "copyleft"), ("name_gpl2_later", "GPL-2.0-or-later", "copyleft"),
        ("name_lgpl21", "LGPL-2.1-only", "copyleft"), ("name_lgpl21_later", "LGPL-2.1-or-later", "copyleft"), ("name_lgpl3", "LGPL-3.0-only", "copyleft"),
        ("name_lgpl3_later", "LGPL-3.0-or-later", "copyleft"), ("name_agpl3", "AGPL-3.0-only", "copyleft"), ("name_agpl3_later", "AGPL-3.0-or-later", "copyleft"),
        ("name_mpl2", "MPL-2.0", "copyleft"), ("name_isc", "ISC", "permissive"), ("name_zlib", "Zlib", "permissive"), ("name_bsl", "BSL-1.0", "permissive"),
        ("name_epl2", "EPL-2.0", "copyleft"), ("name_unlicense", "Unlicense", "permissive"), ("name_cc0", "CC0-1.0", "permissive"),
        ("name_cc_by", "CC-BY-4.0", "permissive"), ("name_cc_by_sa", "CC-BY-SA-4.0", "copyleft"),
    )),
    ("Apache-2.0", "permissive", ("apache_title", "apache_dated")),
    ("GPL-3.0-only", "copyleft", ("gpl_title", "gpl3_dated")),
    ("GPL-2.0-only", "copyleft", ("gpl_title", "gpl2_dated")),
    ("LGPL-2.1-only", "copyleft", ("lgpl_title", "lgpl21_dated")),
    ("AGPL-3.0-only", "copyleft", ("agpl_title", "agpl3_dated")),
    ("MIT", "permissive", ("mit_title", "mit_grant", "mit_notice", "mit_as_is", "mit_liable")),
    ("MIT", "permissive", ("spdx", "name_mit")),
    ("Apache-2.0", "permissive", ("spdx", "name_apache")),
    ("GPL-3.0-only", "copyleft", ("spdx", "name_gpl3")),
    ("GPL-3.0-or-later", "copyleft", ("spdx", "name_gpl3_later")),
    ("BSD-3-Clause", "permissive", ("spdx", "name_bsd3")),
    ("MIT", "permissive", ("mit_grant",)),
    ("MIT", "permissive", ("mit_released",)),
    ("MIT", "permissive", ("mit_licensed",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("Apache-2.0", "permissive", ("apache_head",)),
    ("Apache-2.0", "permissive", ("apache_short",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_terms",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_terms",)),
    ("GPL-3.0-only", "copyleft", ("gpl3_work",)),
    ("GPL-3.0-only", "copyleft", ("gpl3_short",)),
    ("GPL-2.0-only", "copyleft", ("gpl2_short",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_terms",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_terms",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_terms",)),
    ("Zlib", "permissive", ("zlib_grant",)),
    ("BSL-1.0", "permissive", ("boost_head",)),
    ("BSL-1.0", "permissive", ("boost_grant",)),
    ("EPL-2.0", "copyleft", ("epl2",)),
    ("WTFPL", "permissive", ("wtfpl",)),
    ("CC-BY-4.0", "permissive", ("cc_by_work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_work",)),
    ("MPL-2.0", "copyleft", ("mpl2",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("CC0-1.0", "permissive", ("cc0",)),
    ("CC-BY-4.0", "permissive", ("cc_by",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa",)),
    ("CC-BY-NC-4.0", "restricted", ("cc_by_nc",)),
    ("CC-BY-ND-4.0", "restricted", ("cc_by_nd",)),
    ("LicenseRef-all-rights-reserved", "restricted", ("reserved",)),
)
#: Sentence identifiers as single characters, so that a sequence is a text.
CODES = {name: chr(0x100 + i) for i, name in enumerate(SENTENCES)}
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = r"[\x20\x09-\x0D]"
_ENDS = {"lines": rf"[.!?;:]+({_WHITE}+|\z)|\n", "wrapped": rf"[.!?;:]+({_WHITE}+|\z)|\n[^a-z0-9\n]*\n"}


def _pattern(rule: tuple[str, ...]) -> str:
    return "".join(CODES[s] for s in rule)


def _operands(low: Column) -> Column:
    """Lower-cased text in which each operand of an SPDX expression has a line of its own."""
    spread = low
    for _ in range(OPERANDS):
        spread = F.regexp_replace(spread, rf"({_SPDX}[^\n]*?)[ ()]+(?:or|and|with)[ ()]+", f"$1\n{_SPDX} ")
    return F.when(F.contains(low, F.lit(_SPDX)), spread).otherwise(low)


def _filled(s: Column) -> Column:
    """A sentence with the name in its slot left out: the sentence that the template stands for."""
    found = s
    for begin, rest, name in SLOTS:
        fits = s.startswith(begin) & s.endswith(rest) & (F.length(s) > len(begin) + len(rest)) & (F.length(s) <= len(begin) + len(rest) + SLOT)
        found = F.when(fits, F.lit(SENTENCES[name])).otherwise(found)
    found = F.when(s == AFTER_STOP[0], F.lit(SENTENCES[AFTER_STOP[1]])).otherwise(found)
    return F.when(s.startswith("nor the names of") | s.startswith("neither the name") | s.startswith("the name of") | s.startswith("this software is") | s.startswith("in no event"), found).otherwise(s)


def _sequence(text: Column, ends: str) -> Column:
    """The known sentences of a text as a struct: their (position, identifier) in order, and the sequence as a text."""
    marked = F.regexp_replace(let(F.translate(text, _CAPITALS, _SMALL), _operands), ends, "\x01")
    sentences = F.filter(F.transform(F.split(F.regexp_replace(marked, r"[^a-z0-9\x01]+", " "), "\x01"), lambda s: _filled(F.trim(s))), lambda s: s != "")
    known = F.create_map(*(x for name, s in SENTENCES.items() for x in (F.lit(s), F.lit(CODES[name]))))
    # few sentences are long enough, so the map is asked for those that are of a known one's length
    sizes = F.array(*(F.lit(n) for n in sorted({len(s) for s in SENTENCES.values()})))
    coded = F.transform(sentences, lambda s, i: F.struct(i.alias("pos"), F.when(F.array_contains(sizes, F.length(s)), F.try_element_at(known, s)).alias("code")))
    hits = F.filter(coded, lambda x: x["code"].isNotNull())
    return let(hits, lambda h: F.struct(h.alias("hits"), F.array_join(F.transform(h, lambda x, k: F.concat(F.when((k > 0) & (x["pos"] - F.get(h, k - 1)["pos"] > GAP + 1), ".").otherwise(""), x["code"])), "").alias("line")))


#: Sentences that say which licence it is: next to one of them, "all rights reserved" is part of a copyright line.
_TELLING = "".join(CODES[n] for n in SENTENCES if n not in ("reserved", "two_zero", "spdx") and not n.startswith("name_"))


def _unreserved(line: Column) -> Column:
    r = CODES["reserved"]
    return F.regexp_replace(F.regexp_replace(line, f"{r}+([{_TELLING}])", "$1"), f"([{_TELLING}]){r}+", "$1")


def _reserved(lines: Column, wrapped: Column) -> Column:
    """How often "all rights reserved" stands alone: what the readings hold at most, less what either finds next to a licence."""
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(CODES["reserved"]), F.lit("")))
    gone = lambda x: marks(x) - marks(_unreserved(x))
    return F.greatest(F.lit(0), F.greatest(marks(lines), marks(wrapped)) - F.greatest(gone(lines), gone(wrapped)))


def _counts(line: Column) -> Column:
    """How often each rule matches a sequence, in the rules' order; matched sentences are used up."""
    marks = lambda x: F.length(F.translate(x, "".join(CODES.values()) + ".", ""))

    def step(acc: Column, pattern: Column) -> Column:
        # each match of a rule's sentences becomes one mark, so marks count matches
        return let(F.replace(acc["left"], pattern, F.lit("#")), lambda left: F.struct(left.alias("left"), F.concat(acc["n"], F.array(marks(left) - marks(acc["left"]))).alias("n")))

    start = F.struct(_unreserved(line).alias("left"), F.array().cast("array<int>").alias("n"))
    return F.aggregate(F.array(*(F.lit(_pattern(rule)) for _, _, rule in RULES)), start, step, lambda acc: acc["n"])


#: The rules of each rule's licence, by number.
_SAME = [[j for j, other in enumerate(RULES) if other[0] == rule[0]] for rule in RULES]


def _chosen(lines: Column, wrapped: Column) -> Column:
    """Each rule's count in the reading that finds its licence more often, the wrapped one where both agree."""
    total = lambda n, k: reduce(lambda a, b: a + b, (F.get(n, j) for j in _SAME[k]))
    pick = lambda a, b, k: F.when(total(b, k) >= total(a, k), F.get(b, k)).otherwise(F.get(a, k))
    return let(lines, lambda a: let(wrapped, lambda b: F.array(*(pick(a, b, k) for k in range(len(RULES))))))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``sentences``, ``matches`` (licence, class, count by rule) and ``licenses``.

    ``sentences`` are those of both readings (reading, position in it, identifier).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = {"sentences", "matches", "licenses", "_lines", "_wrapped"}
    read = df.select(*(c for c in df.columns if c.lower() not in own), *(_sequence(whole, e).alias(f"_{n}") for n, e in _ENDS.items()))
    names = F.create_map(*(F.lit(x) for name, code in CODES.items() for x in (code, name)))
    rules = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("class")) for a, b, _ in RULES))
    # most texts hold nothing: the rules run only where a sequence is
    none = (F.col("_lines.line") == "") & (F.col("_wrapped.line") == "")
    chosen = _chosen(_counts(F.col("_lines.line")), _counts(F.col("_wrapped.line")))
    counted = F.when(none, F.array().cast("array<int>")).otherwise(F.concat(F.slice(chosen, 1, len(RULES) - 1), F.array(_reserved(F.col("_lines.line"), F.col("_wrapped.line")))))
    rated = lambda n, i: F.struct(F.get(rules, i)["license"].alias("license"), F.get(rules, i)["class"].alias("class"), n.alias("n"))
    matches = F.filter(F.transform(counted, rated), lambda m: m["n"] > 0)

    def listed(reading: str) -> Column:
        return F.transform(f"_{reading}.hits", lambda h: F.struct(F.lit(reading).alias("reading"), h["pos"].alias("pos"), F.element_at(names, h["code"]).alias("sentence")))

    found = read.withColumn("sentences", F.concat(*(listed(n) for n in _ENDS))).withColumn("matches", matches)
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))).drop("_lines", "_wrapped")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents scanned for licences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    total = F.aggregate("matches", F.lit(0), lambda s, m: s + m["n"]).cast("long")
    return scan(docs).select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), total.alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["class"]))), ",").alias("classes"))


def _sql_sentences(text: str, ends: str) -> str:
    """The sentences of a text, in SQL."""
    low = f"translate({text}, '{_CAPITALS}', '{_SMALL}')"
    spread = low
    for _ in range(OPERANDS):
        spread = f"regexp_replace({spread}, '({_SPDX}[^\\n]*?)[ ()]+(?:or|and|with)[ ()]+', '\\1\n{_SPDX} ', 'g')"
    slots = "s"
    for begin, rest, name in SLOTS:
        slots = f"CASE WHEN starts_with(s, '{begin}') AND ends_with(s, '{rest}') AND length(s) > {len(begin) + len(rest)} AND length(s) <= {len(begin) + len(rest) + SLOT} THEN '{SENTENCES[name]}' ELSE {slots} END"
    slots = f"CASE WHEN s = '{AFTER_STOP[0]}' THEN '{SENTENCES[AFTER_STOP[1]]}' ELSE {slots} END"
    plain = f"regexp_replace(regexp_replace({spread}, '{ends}', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g')"
    return f"list_filter(list_transform(list_transform(string_split({plain}, chr(1)), lambda s: trim(s, ' ')), lambda s: {slots}), lambda s: s <> '')"


def _sql() -> str:
    codes = "".join(CODES.values())
    known = "MAP {" + ", ".join(f"'{s}': '{CODES[n]}'" for n, s in SENTENCES.items()) + "}"
    reads, steps = [], []
    reserved = CODES["reserved"]
    held = lambda x: f"(length({x}) - length(replace({x}, '{reserved}', '')))"
    near = f"regexp_replace(regexp_replace(string_agg(p, '' ORDER BY i), '{reserved}+([{_TELLING}])', '\\1', 'g'), '([{_TELLING}]){reserved}+', '\\1', 'g')"
    for name, ends in _ENDS.items():
        reads.append(
            f"s_{name} AS (SELECT rid, {_sql_sentences('t', ends)} AS ss FROM d), "
            f"c_{name} AS (SELECT rid, i, k.code FROM (SELECT rid, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM s_{name}) JOIN k ON k.s = s.s), ".replace("FROM (SELECT rid, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM s_" + name + ")", f"FROM (SELECT rid, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM s_{name}) s")
            + f"g_{name} AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) > {GAP + 1} THEN '.' ELSE '' END || code AS p FROM c_{name}), "
            f"l_{name} AS (SELECT rid, count(*) AS n, {near} AS x0, {held("string_agg(p, '' ORDER BY i)")} AS raw, {held("string_agg(p, '' ORDER BY i)")} - {held(near)} AS gone FROM g_{name} GROUP BY rid)"
        )
    chain = lambda name: reduce(lambda sql, k: f"SELECT *, replace(x{k}, '{_pattern(RULES[k][2])}', '#') AS x{k + 1} FROM ({sql})", range(len(RULES)), f"SELECT * FROM l_{name}")
    marks = lambda k: f"length(translate(x{k + 1}, '{codes}.', '')) - length(translate(x{k}, '{codes}.', ''))"
    for name in _ENDS:
        steps.append(f"r_{name} AS (SELECT rid, n, raw, gone, " + ", ".join(f"{marks(k)} AS m{k}" for k in range(len(RULES))) + f" FROM ({chain(name)}))")
    of = lambda t, k: f"coalesce({t}.m{k}, 0)"
    alone = "greatest(0, greatest(coalesce(a.raw, 0), coalesce(b.raw, 0)) - greatest(coalesce(a.gone, 0), coalesce(b.gone, 0)))"
    every = lambda t, k: " + ".join(of(t, j) for j in _SAME[k])
    count = lambda k: f"CASE WHEN {every('b', k)} >= {every('a', k)} THEN {of('b', k)} ELSE {of('a', k)} END" if k + 1 < len(RULES) else alone
    chosen = "m AS (SELECT d.doc_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, " + ", ".join(f"{count(k)} AS m{k}" for k in range(len(RULES)))
    chosen += " FROM d LEFT JOIN r_lines a USING (rid) LEFT JOIN r_wrapped b USING (rid))"
    pick = lambda i: "list_filter([" + ", ".join(f"CASE WHEN m{k} > 0 THEN '{r[i]}' END" for k, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
    total = " + ".join(f"m{k}" for k in range(len(RULES)))
    joined = lambda i: f"array_to_string(list_sort(list_distinct({pick(i)})), ',')"
    return (
        f"WITH k AS (SELECT unnest(map_keys(m)) AS s, unnest(map_values(m)) AS code FROM (SELECT {known} AS m)), d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        + ", ".join(reads)
        + ", "
        + ", ".join(steps)
        + ", "
        + chosen
        + f" SELECT doc_id, n::BIGINT AS n_sentences, ({total})::BIGINT AS n_matches, {joined(0)} AS licenses, {joined(1)} AS classes FROM m"
    )


SQL = _sql()
