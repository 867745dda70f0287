"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences at blank lines and at sentence marks, so that a sentence wrapped over lines is one. Each is normalised (small
letters, only letters, digits and dots inside numbers, single spaces) and mapped to the identifier of a known licence sentence. Where
the whole is unknown, it may begin at a later line (a heading without a mark stands before it), at most LINES before its end; lines that are
known alone count too. The identifiers of a document, in order, are matched against ordered licence rules: a rule is a sequence of
identifiers, between which up to `gap` other known sentences may stand; the first rule of the list that fits an unclaimed place
claims it. All of it is one projection: no exchange, any table size.

Defined cases: null or empty text has no sentences and no licence; repeated sentences count each; a known sentence that no
rule claims is reported as unknown licence text; "all rights reserved" makes a text proprietary only if no licence is found; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import text_of

# Sentences of licence texts and notices, by identifier; `normal` makes them comparable.
TEXTS = {
    "MIT1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT4": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT5": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "ISC1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC2": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "ISC3": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC4": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ZB1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "B1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "B2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "B3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "B4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "B5": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "B6": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    "B7": "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer.",
    "B8": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "A1": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "A2": "you may not use this file except in compliance with the License.",
    "A3": "You may obtain a copy of the License at",
    "A4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "A5": "See the License for the specific language governing permissions and limitations under the License.",
    "A6": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "A7": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "A8": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "F1": "This program is free software;",
    "F2": "This library is free software;",
    "F3": "This software is free software;",
    "W1": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "W2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "W3": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "V2": "either version 2 of the License, or (at your option) any later version.",
    "V21": "either version 2.1 of the License, or (at your option) any later version.",
    "V3": "either version 3 of the License, or (at your option) any later version.",
    "T1": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "T2": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "T3": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "T4": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "T5": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "MPL2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL3": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL4": "Mozilla Public License Version 2.0",
    "EPL1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL2": "Eclipse Public License - v 2.0",
    "BSL1": "Boost Software License - Version 1.0 - August 17th, 2003",
    "BSL2": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "U1": "This is free and unencumbered software released into the public domain.",
    "U2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CZ1": "CC0 1.0 Universal",
    "CZ2": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Z1": "This software is provided 'as-is', without any express or implied warranty.",
    "Z2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Z3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "PG1": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "PSF1": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "ART1": "The Artistic License 2.0",
    "WTF1": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    "P1": "All rights reserved.",
}
# Licences of notices by their registered identifier, and what notices call them.
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "MIT-0": ("MIT No Attribution License",),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License",),
    "BSD-2-Clause": ("2-Clause BSD License", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("3-Clause BSD License", "BSD 3-Clause License", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "PostgreSQL": ("PostgreSQL License",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
# Fixed value: how notices begin, normalised: who is licensed, and how they say so. It becomes one word.
NOTICE = r"^(?:(?:this work|this project|this software|this program|this library|this file|the code) is )?(?:licensed|released|distributed|available|published) under (?:the |a )?"
# The licences of the GNU project, by name and version as their notices state them.
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = (("GPL", "2", "2.0"), ("GPL", "3", "3.0"), ("LGPL", "2.1", "2.1"), ("LGPL", "3", "3.0"), ("AGPL", "3", "3.0"))
WORKS = ("This program", "This library", "This software", "This file", "You")
#: What a text without any licence that reserves all rights is called.
PROPRIETARY = "Proprietary"
#: Lines before its end in which a known sentence may begin inside a longer one.
LINES = 40
#: Other known sentences that may stand between two of a rule.
GAP = 1


def normal(sentence: str) -> str:
    """As `normalised` does, for the tables."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    plain = re.sub(r"[^a-z0-9.]+", " ", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", low)).strip(" ")
    return re.sub(NOTICE, "under ", plain)


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifier of each normalised sentence, and the ordered rules (licence, sequence of identifiers), the most specific first."""
    known = {normal(s): i for i, s in TEXTS.items()}
    notices: list[tuple[str, tuple[str, ...]]] = []
    for n, (licence, names) in enumerate(NAMES.items(), 1):
        for name in names:
            known.setdefault(normal(f"Licensed under the {name}"), f"N{n}")
        known.setdefault(normal(f"SPDX-License-Identifier: {licence}"), f"N{n}")
        notices.append((licence, (f"N{n}",)))
    gnu: list[tuple[str, tuple[str, ...]]] = []
    for n, (family, version, long) in enumerate(GNU_VERSIONS, 1):
        name = GNU[family]
        later = f"either version {version} of the License, or (at your option) any later version"
        for work in WORKS:
            free = "" if work == "You" else f"{work} is free software: "
            known.setdefault(normal(f"{free}you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {later}"), f"GL{n}")
            known.setdefault(normal(f"{free}you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation"), f"GO{n}")
        for kind, said in (("GL", "or-later"), ("GO", "only")):
            known.setdefault(normal(f"SPDX-License-Identifier: {family}-{long}-{said}"), f"{kind}{n}")
            gnu += [(f"{family}-{long}-{said}", (f"{kind}{n}", w, "W3")) for w in ("W1", "W2")] + [(f"{family}-{long}-{said}", (f"{kind}{n}",))]
        known.setdefault(normal(f"You can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"), f"GF{list(GNU).index(family) + 1}")
        gnu += [(f"{family}-{long}-or-later", (f, f"GF{list(GNU).index(family) + 1}", f"V{version.replace('.', '')}")) for f in ("F1", "F2", "F3")]
    rules = [
        ("MIT", ("MIT1", "MIT2", "MIT3", "MIT4")),
        ("MIT-0", ("MIT5", "MIT3", "MIT4")),
        ("MIT", ("MIT1", "MIT3")),
        ("MIT", ("MIT1",)),
        ("MIT-0", ("MIT5",)),
        ("ISC", ("ISC1", "ISC2", "ISC3")),
        ("ISC", ("ISC4", "ISC2", "ISC3")),
        ("ISC", ("ISC1",)),
        ("ISC", ("ISC4",)),
        ("0BSD", ("ZB1", "ISC2", "ISC3")),
        ("0BSD", ("ZB1",)),
        ("BSD-3-Clause", ("B1", "B2", "B3", "B4", "B5", "B6")),
        ("BSD-3-Clause", ("B1", "B2", "B3", "B4")),
        ("BSD-3-Clause", ("B1", "B7", "B3", "B4")),
        ("BSD-3-Clause", ("B1", "B2", "B3", "B8")),
        ("BSD-2-Clause", ("B1", "B2", "B3", "B5", "B6")),
        ("BSD-2-Clause", ("B1", "B2", "B3")),
        ("BSD-2-Clause", ("B1", "B7", "B3")),
        ("Apache-2.0", ("A1", "A2", "A3", "A4", "A5")),
        ("Apache-2.0", ("A1", "A2", "A4")),
        ("Apache-2.0", ("A8", "A2", "A3", "A4", "A5")),
        ("Apache-2.0", ("A6", "A7")),
        ("Apache-2.0", ("A1",)),
        *gnu,
        ("GPL-2.0", ("T1",)),
        ("GPL-3.0", ("T2",)),
        ("LGPL-2.1", ("T3",)),
        ("LGPL-3.0", ("T4",)),
        ("AGPL-3.0", ("T5",)),
        ("MPL-2.0", ("MPL1", "MPL2")),
        ("MPL-2.0", ("MPL1", "MPL3")),
        ("MPL-2.0", ("MPL1",)),
        ("MPL-2.0", ("MPL4",)),
        ("EPL-2.0", ("EPL1",)),
        ("EPL-2.0", ("EPL2",)),
        ("BSL-1.0", ("BSL1", "BSL2")),
        ("BSL-1.0", ("BSL1",)),
        ("BSL-1.0", ("BSL2",)),
        ("Unlicense", ("U1", "U2")),
        ("Unlicense", ("U1",)),
        ("CC0-1.0", ("CZ1",)),
        ("CC0-1.0", ("CZ2",)),
        ("Zlib", ("Z1", "Z2", "Z3")),
        ("Zlib", ("Z3",)),
        ("PostgreSQL", ("PG1",)),
        ("PSF-2.0", ("PSF1",)),
        ("Artistic-2.0", ("ART1",)),
        ("WTFPL", ("WTF1",)),
        *notices,
        (PROPRIETARY, ("P1",)),
    ]
    return known, rules


SENTENCES, RULES = _tables()
#: Single words of which every known sentence has one, as normalisation keeps them whole; sentences without any are not looked up.
MARKERS = r"(?i)licen[sc]e|permission|software|program|redistribution|reserved|spdx|warrant|version|universal|under|mpl|liable"
#: Line ends to one form; what only this module puts into a text, for ends of sentences, and the dots of numbers in SQL.
LINE_END, OWN_MARKS = r"\r\n?", r"[\x01\x02]"
#: A blank line, perhaps with the marks of a comment; a sentence mark before white space or the end. Both end a sentence.
BLANK_LINE = r"\n(?:[ \t*#/;%!<>|=+~_-]*\n)+"
SENTENCE_END = r"[.!?;]+([ \t\n\x0B\x0C]|\z)"


def normalised(sentence: Column) -> Column:
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, r"(?<![0-9])\.|\.(?![0-9])", " "), r"[^a-z0-9.]+", " "))
    return F.regexp_replace(plain, NOTICE, "under ")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def sentence_ids(text: Column) -> Column:
    """Array of (place among the text's sentences, identifier) of its known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    id_of = lambda s: F.try_element_at(known, normalised(s))
    plain = F.regexp_replace(F.regexp_replace(text, OWN_MARKS, " "), LINE_END, "\n")
    ended = F.regexp_replace(F.regexp_replace(plain, BLANK_LINE, "\x02"), SENTENCE_END, "\x02$1")
    placed = F.transform(F.split(ended, "\x02"), lambda s, i: F.struct(i.cast("int").alias("place"), s.alias("sentence")))
    likely = F.filter(placed, lambda x: x["sentence"].rlike(MARKERS))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        starts = F.when(n > 0, F.sequence(F.greatest(n - LINES + 1, F.lit(1)), n)).otherwise(F.array().cast("array<int>"))
        whole = F.transform(starts, lambda i: F.struct(i.alias("line"), id_of(F.array_join(F.slice(lines, i, n), " ")).alias("id")))
        first = F.get(F.filter(whole, lambda x: x["id"].isNotNull()), 0)
        return _with(first, lambda hit: F.concat(
            F.filter(F.transform(F.slice(lines, 1, F.coalesce(hit["line"] - 1, n)), lambda line: F.when(line.rlike(MARKERS), id_of(line))), lambda x: x.isNotNull()),
            F.when(hit.isNull(), F.array().cast("array<string>")).otherwise(F.array(hit["id"])),
        ))

    def ids(x: Column) -> Column:
        lines = F.filter(F.split(x["sentence"], "\n"), lambda line: line.rlike("[A-Za-z0-9]"))
        return F.transform(_with(lines, of_lines), lambda i: F.struct(x["place"].alias("place"), i.alias("id")))

    return F.flatten(F.transform(likely, ids))


def rule_pattern(sequence: tuple[str, ...], gap: int) -> str:
    """Identifiers, each with a space after it, that begin at a word's edge."""
    return r"\b" + f"(?:[A-Z]+[0-9]+ ){{0,{gap}}}?".join(f"{i} " for i in sequence)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """One row per document: doc_id, sentence_ids, places, licenses (sorted, joined by comma), n_matches, n_unclaimed."""
    ids = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text_of(text_col)).alias("known"))
    seen = ids.select("doc_id", "known", F.array_join("known.id", " ").alias("sequence"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(s, gap)).alias("pattern")) for name, s in RULES])
    start = F.struct(F.concat("sequence", F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def claim(state: Column, rule: Column) -> Column:
        # a claimed place becomes a bar, so that nothing matches across it
        found = F.regexp_count(state["left"], rule["pattern"]).cast("long")
        return F.struct(
            F.regexp_replace(state["left"], rule["pattern"], F.lit("| ")).alias("left"),
            F.when(found > 0, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
            (state["n"] + found).alias("n"),
        )

    claimed = seen.withColumn("c", F.when(F.col("sequence") != "", F.aggregate(rules, start, claim)))
    names = F.coalesce("c.names", F.array().cast("array<string>"))
    names = F.when(F.size(names) > 1, F.array_remove(names, PROPRIETARY)).otherwise(names)
    return claimed.select(
        "doc_id",
        F.col("sequence").alias("sentence_ids"),
        F.array_join(F.col("known.place").cast("array<string>"), " ").alias("places"),
        F.array_join(F.array_sort(names), ",").alias("licenses"),
        F.coalesce("c.n", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.regexp_count(F.col("c.left"), F.lit("[A-Z]+[0-9]+")), F.lit(0)).cast("long").alias("n_unclaimed"),
    )
