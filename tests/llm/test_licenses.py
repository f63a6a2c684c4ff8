import random

from pyspark.sql import functions as F

from thalweg.llm import licenses


def share(words, template):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return len(grams(template) & grams(words)) / len(grams(template))


def brute(text, templates):
    words = licenses.words_of(text or "")
    found = []
    for name, texts in templates.items():
        for t in map(licenses.words_of, texts):
            required = [p for p in licenses.REQUIRED.get(name, []) if f" {p} " in f" {' '.join(t)} "]
            if share(words, t) >= 0.8 and all(f" {p} " in f" {' '.join(words)} " for p in required):
                found.append((name, t))
    longer = lambda name, t: any(n != name and len(u) > len(t) and share(u, t) >= 0.8 for n, u in found)
    return ",".join(sorted({name for name, t in found if not longer(name, t)}))


def test_against_brute_force_on_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    want = {r.doc_id: brute(r.text, licenses.TEMPLATES) for r in docs.collect()}
    assert got == want and len({v for v in want.values() if v}) >= 3


def test_edited_and_long_notices(spark):
    rng = random.Random(6)
    long_ = {"Long": [" ".join(f"w{rng.randrange(90)}" for _ in range(150))], "Odd": ["it's a \"quoted\" \\ slashed notice, O'Neil"]}
    templates = licenses.TEMPLATES | long_
    rows = []
    for i in range(250):
        name = rng.choice(list(templates))
        words = rng.choice(templates[name]).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        filler = lambda: [f"f{rng.randrange(500)}" for _ in range(rng.randrange(200))]
        rows.append((i, "\n".join(filler() + words + filler())))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    for i, text in rows:
        assert got[i].licenses == brute(text, templates), text
        for match in filter(None, got[i].matches.split(",")):
            name, word, part = match.split(":")
            assert licenses.words_of(text)[int(word)] in {w for t in templates[name] for w in licenses.words_of(t)} and float(part) >= 0.8


def test_bands_keep_their_promise():
    assert len(licenses.TEMPLATES) >= 30
    for p in licenses.pieces(licenses.TEMPLATES):
        own, window = len(p["piece"]) - 4, 2 * p["window"] - 4
        held = max(1, -(-4 * own // 5))
        assert (1 - held / (window + own - held)) ** p["bands"] <= licenses.MISS
        assert len(p["piece"]) <= p["window"]


def test_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (None, f"É {notice}"), (4, f"{notice} " * 5000), (5, "Released under the"), (6, "z " * 60_000 + notice.upper())]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("licenses", F.lit(1))
    got = sorted(((r.doc_id, r.matches) for r in licenses.scan(given).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "MIT:0:1.0"), (3, "MIT:0:1.0"), (4, "MIT:0:1.0"), (5, ""), (6, "MIT:60000:1.0"), (None, "MIT:1:1.0")]
    assert got == sorted(want, key=str)
    assert licenses.scan(given.limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark, folder):
    plan = licenses.scan(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


#: Headers as files carry them, written down for this test.
HEADERS = {
    "GPL-2.0": """/* This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version. */""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,""",
    "LGPL-2.1": """ This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Lesser General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "AGPL-3.0": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as
 * published by the Free Software Foundation, either version 3 of the
 * License, or (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" """,
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
   * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution.
   * Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software
     without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "MPL-2.0": """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at""",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def test_standard_headers_are_named_rightly(spark):
    rows = [(i, f"Some words before it all. {text} And some after it.") for i, text in enumerate(HEADERS.values())]
    rows += [(100, HEADERS["GPL-3.0"] + " middle " * 300 + HEADERS["MIT"]), (101, HEADERS["BSD-3-Clause"] + " gap" * 400 + " " + HEADERS["BSD-2-Clause"])]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {name: got[i] for i, name in enumerate(HEADERS)} == {name: name for name in HEADERS}
    assert got[100] == "GPL-3.0,MIT" and got[101] == "BSD-2-Clause,BSD-3-Clause"
