import random
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from netsets.llm.license_scan import MARKERS, RULES, SENTENCES, license_scan
from netsets.llm.queries import ORACLES

# the texts as published, not taken from the operator's table
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
"""
LGPL21 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
AGPL = GPL3.replace("GNU General", "GNU Affero General")
BSD3 = """Copyright (c) 2019, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
"""
BSD2 = re.sub(r"3\. Neither.*?permission\.\n", "", BSD3, flags=re.S)
ISC = """Copyright 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
PUBLISHED = [
    (MIT, "MIT"), (APACHE, "Apache-2.0"), (ASF, "Apache-2.0"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (LGPL21, "LGPL-2.1-or-later"),
    (AGPL, "AGPL-3.0-or-later"), (BSD3, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (ISC, "ISC"), (MPL, "MPL-2.0"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"),
    (BOOST, "BSL-1.0"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    ("   GNU LESSER GENERAL PUBLIC LICENSE\n       Version 2.1, February 1999\n", "LGPL-2.1"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n", "CC0-1.0"),
    ("// SPDX-License-Identifier: BSD-3-Clause\nint main() {}", "BSD-3-Clause"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"),
    ("This project is licensed under the MIT License.", "MIT"), ("text before\nReleased under the MIT License.\ntext after", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Some company. All rights reserved.", "Proprietary"), (f"All rights reserved.\n\n{MIT}", "MIT"), (f"{MIT}\n\n{APACHE}", "Apache-2.0,MIT"),
    ("The MIT campus has a license office; the software there is free, and permission to enter is granted.", ""), ("", ""), (None, ""),
]


def forms(text):
    """As published, in one line a paragraph, wrapped anew, with other line ends, as a comment."""
    yield text
    if not text:
        return
    paragraphs = [re.sub(r"\s*\n[ \t*#/]*", " ", p) for p in re.split(r"\n[ \t*#/]*\n", text)]
    if not re.search(r"before\n|main", text):
        yield "\n\n".join(paragraphs)
        yield "\n\n".join(textwrap.fill(p.strip(), 45) for p in paragraphs)
        yield "\n#\n".join(textwrap.fill(p.strip(), 60, initial_indent="# ", subsequent_indent="# ") for p in paragraphs)
    yield text.replace("\n", "\r\n")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, known string, n0 int").repartition(3)


COLUMNS = ("sentence_ids", "licenses", "n_matches", "n_unclaimed")


def by_sql(texts):
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.array(texts, "string")}))
    return {r[0]: r[1:] for r in duck.sql(f"SELECT doc_id, {', '.join(COLUMNS)} FROM ({ORACLES['op2_license_scan']})").fetchall()}


def by_spark(spark, texts):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in license_scan(frame(spark, texts)).collect()}


def test_published_texts(spark):
    cases = [(form, licence) for text, licence in PUBLISHED for form in forms(text)]
    got = by_spark(spark, [text for text, _ in cases])
    assert [(got[i][1], text) for i, (text, _) in enumerate(cases)] == [(licence, text) for text, licence in cases]
    assert by_sql([text for text, _ in cases]) == got
    assert len({name for name, _ in RULES}) >= 30


def normal(s):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    s = re.sub(r"[^a-z0-9.]+", " ", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", s)).strip(" ")
    return re.sub(r"^((this (work|project|software|program|library|file)|the code) is )?(licensed|released|distributed|available|published) under (the |a )?", "under ", s)


def ids_of(text):
    out = []
    text = re.sub(r"\r\n?", "\n", re.sub("[\x01\x02]", " ", text or ""))
    for sentence in re.split(r"\n(?:[ \t*#/;%!<>|=+~_-]*\n)+", text):
        for s in re.split(r"[.!?;]+(?=[ \t\n\x0b\x0c]|\Z)", sentence):
            lines = [x for x in s.split("\n") if re.search("[A-Za-z0-9]", x)]
            keys = [normal(" ".join(lines[i:])) for i in range(len(lines))]
            begin = next((i for i, k in enumerate(keys) if len(lines) - i <= 40 and k in SENTENCES), None)
            alone = lines if begin is None else lines[:begin]
            out += [SENTENCES[normal(x)] for x in alone if normal(x) in SENTENCES]
            out += [] if begin is None else [SENTENCES[keys[begin]]]
    return out


def brute(text, gap=1):
    ids = ids_of(text)
    free, names, n = list(ids), set(), 0
    for name, sequence in RULES:
        at = 0
        while at < len(free):
            places, i = [], at
            for k, want in enumerate(sequence):
                room = gap if k else 0
                while i < len(free) and free[i] and free[i] != want and room:
                    i, room = i + 1, room - 1
                if i < len(free) and free[i] == want:
                    places.append(i)
                    i += 1
                else:
                    places = None
                    break
            if places:
                free[places[0] : places[-1] + 1] = [None] * (places[-1] + 1 - places[0])
                names.add(name)
                n += 1
                at = places[-1] + 1
            else:
                at += 1
    if len(names) > 1:
        names.discard("Proprietary")
    return " ".join(ids), ",".join(sorted(names)), n, sum(x is not None for x in free)


def test_against_brute_force_and_sql(spark):
    rng = random.Random(2)
    pool = [s for s, _ in SENTENCES.items()] + ["Some program about nothing", "Version 2.0 is out", "a heading"]
    joins = [". ", "\n", ".\n", "\n\n", ";\n * ", "\n#\n", " "]
    texts = []
    for _ in range(250):
        some = rng.sample(pool, 4)
        text = ""
        for _ in range(rng.randrange(8)):
            sentence = rng.choice(some)
            text += (textwrap.fill(sentence, 40) if rng.random() < 0.3 else sentence) + rng.choice(joins)
        texts.append(text)
    texts += [None, "", "\n\n", "x. " * 100_000 + "Released under the MIT License.", "no end licensed under the MIT license", "a\x01license\x02 b", "under\n" * 200, "software\n" * 3000]
    got = by_spark(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert by_sql(texts) == got
    assert any("MIT" in x[1] for x in got.values()) and any(x[3] for x in got.values())
    assert license_scan(frame(spark, texts).limit(0)).collect() == []


def test_plan_has_no_exchange_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_every_sentence_has_a_marker():
    assert not [s for s in SENTENCES if not re.search(MARKERS, s)]


@pytest.mark.parametrize("gap", ["\t", "\u00a0", " - ", "  "])
def test_odd_white_space(spark, gap):
    texts = ["All  rights reserved", "All\trights reserved.", "All\u00a0rights reserved", "ALL-RIGHTS-RESERVED"]
    texts += [re.sub(" ", gap, s) for s in SENTENCES]
    got = by_spark(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t) and got[i][0], t
