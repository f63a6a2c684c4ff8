"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Everything here is SQL expressions within a document's own row: nothing is
shuffled, and the templates are literals.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"""{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: The same conditions without numbers.
_BSD_2_LISTED = re.sub(r"\b[12]\. ", "", _BSD_2)
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_ANY_PURPOSE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_CC = "This work is licensed under a Creative Commons {} International License."
#: Notices by which works are put under a license.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", f"{_GRANT}, to deal in the Software without restriction", f"{_GRANT} (the Software), to deal in the Software without restriction"],
    "NCSA": [f"{_GRANT} (the Software), to deal with the Software without restriction"],
    "ISC": [f"{_ANY_PURPOSE}, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": [f"{_ANY_PURPOSE}."],
    "BSD": [_BSD],
    "BSD-2-Clause": [_BSD_2, _BSD_2_LISTED],
    "BSD-3-Clause": [f"{_BSD_2} 3. {_NO_NAMES}", f"{_BSD_2_LISTED} {_NO_NAMES}"],
    "BSD-4-Clause": [_ADVERTISING],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 2.",
        _GNU.format("program", ";", "General Public", "2"),
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("program", ":", "General Public", "3")],
    "LGPL-2.0": [_GNU.format("library", ";", "Library General Public", "2")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format("library", ";", "Lesser General Public", "2.1")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", ":", "Lesser General Public", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("program", ":", "Affero General Public", "3")],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "MS-PL": ["This license governs use of the accompanying software. If you use the software, you accept this license."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution 4.0")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike 4.0")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives 4.0")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial 4.0")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike 4.0")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format("Attribution-NonCommercial-NoDerivatives 4.0")],
}
#: Wording that tells a license from its like; a notice that has it counts only where it stands too.
REQUIRED = {
    "MIT": ["mit license", "deal in the software"],
    "NCSA": ["deal with the software"],
    "ISC": ["appear in all copies"],
    "BSD-3-Clause": ["neither the name of"],
    "BSD-4-Clause": ["all advertising materials"],
    "GPL-2.0": ["gnu general public license", "version 2"],
    "GPL-3.0": ["gnu general public license", "version 3"],
    "LGPL-2.0": ["gnu library general public license", "version 2"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3"],
    "AGPL-3.0": ["gnu affero general public license", "version 3"],
    "MPL-1.1": ["mozilla public license", "version 1 1"],
    "EPL-1.0": ["eclipse public license v1"],
    "EPL-2.0": ["eclipse public license v2", "eclipse public license 2 0"],
    "CC-BY-4.0": ["cc by 4 0", "attribution 4 0"],
    "CC-BY-SA-4.0": ["by sa 4 0", "attribution sharealike 4 0"],
    "CC-BY-ND-4.0": ["by nd 4 0", "attribution noderivatives 4 0"],
    "CC-BY-NC-4.0": ["by nc 4 0", "attribution noncommercial 4 0"],
    "CC-BY-NC-SA-4.0": ["by nc sa 4 0", "noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["by nc nd 4 0", "noncommercial noderivatives 4 0"],
}
WORDS, CONTAINED = 5, 0.8
#: Lengths of the pieces that templates are cut into, in words; windows are twice as long and overlap by half.
CLASSES = (8, 16, 32)
#: Allowed chance that the bands miss a piece which is there with ``CONTAINED`` of its shingles.
MISS = 1e-6

_SPLIT = r"[^\\p{L}\\p{N}]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


def notices(templates: dict[str, list[str]]) -> list[dict]:
    """Each distinct notice: name, words, the wording it requires, and the numbers of the notices that it goes before.

    A notice goes before one of another license that it holds as a part, where
    both are found in one place.
    """
    made: list[dict] = []
    for name, texts in templates.items():
        for text in texts:
            words = words_of(text)
            if len(words) < WORDS:
                raise ValueError(f"a template needs {WORDS} words: {text!r}")
            if words not in [m["words"] for m in made]:
                held = f" {' '.join(words)} "
                made.append({"name": name, "words": words, "required": [p for p in REQUIRED.get(name, []) if f" {p} " in held]})
    for m in made:
        own = set(_grams(m["words"]))
        parts = [(i, _grams(x["words"])) for i, x in enumerate(made) if x["name"] != m["name"] and len(x["words"]) < len(m["words"])]
        m["before"] = [i for i, grams in parts if len(own & set(grams)) / len(grams) >= CONTAINED - 1e-9]
    return made


def bands(size: int, window: int) -> int:
    """Bands of one row that a piece's window needs: each agrees with a chance of the Jaccard similarity."""
    own, all_ = max(1, size - WORDS + 1), 2 * window - WORDS + 1
    held = max(1, math.ceil(CONTAINED * own))
    similar = held / (all_ + own - held)
    return math.ceil(math.log(MISS) / math.log(1 - similar))


def pieces(templates: dict[str, list[str]]) -> list[dict]:
    """The notices' pieces: the notice's number, the piece's place in it, its window length and bands."""
    made = []
    for number, notice in enumerate(notices(templates)):
        words = notice["words"]
        cuts = [*range(0, max(len(words) - CLASSES[-1] // 2, 1), CLASSES[-1]), len(words)]
        for start, stop in pairwise(cuts):
            stop = min(max(stop, start + WORDS), start + CLASSES[-1], len(words))
            window = next(c for c in CLASSES if c >= stop - start)
            made.append({"template": number, "at": start, "piece": words[start:stop], "window": window, "bands": bands(stop - start, window)})
    return made


def _hash(row: str, i: str) -> str:
    return f"xxhash64({', '.join(f'{row}[{i} + {k}]' for k in range(WORDS))})"


def _texts(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(2**63) else "bigint('-9223372036854775808')" for v in values) + ")"


def _literals(docs: DataFrame, templates: dict[str, list[str]]) -> tuple[dict[int, str], str, list[int]]:
    """SQL literals: per class the pieces with their bands' values, the notices, and all shingle hashes."""
    spark, made = docs.sparkSession, pieces(templates)

    def evaluate(sqls: list[str]) -> list:
        return spark.sql("SELECT " + ", ".join(f"{sql} AS v{i}" for i, sql in enumerate(sqls))).first()

    hashes = evaluate([f"transform(sequence(0, {len(p['piece']) - WORDS}), i -> {_hash(_texts(p['piece']), 'i')})" for p in made])
    values = evaluate([f"transform(sequence(1, {p['bands']}), b -> {_least('t', 'b').replace('t_rows', _longs(h))})" for p, h in zip(made, hashes)])
    by_class = {}
    for window in CLASSES:
        rows = [f"struct({p['template']} AS template, {p['at']} AS at, {_longs(v)} AS bands)" for p, v in zip(made, values) if p["window"] == window]
        if rows:
            by_class[window] = f"array({', '.join(rows)})"
    known = [
        f"struct('{n['name']}' AS name, {len(n['words'])} AS n, {_texts(_grams(n['words']))} AS shingles,"
        f" CAST({_texts([f' {p} ' for p in n['required']])} AS ARRAY<STRING>) AS required, CAST(array({', '.join(map(str, n['before']))}) AS ARRAY<INT>) AS before)"
        for n in notices(templates)
    ]
    return by_class, f"array({', '.join(known)})", sorted({h for row in hashes for h in row})


def _least(name: str, band: str) -> str:
    """SQL for a band's value: the least of the shingles' hashes after the band's own mixing."""
    return f"array_min(transform({name}_rows, h -> xxhash64(h, {band})))"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """For every document the licenses whose notices it holds, and where.

    ``licenses`` lists names in order, ``matches`` adds, for the best passage
    of each, the first word and the share of the notice's five-word shingles
    that are in it, four fifths at least.  Wording that tells a license from
    its like (``REQUIRED``) must stand in the passage; where a notice is part of
    another license's that is found in the same place, the longer one counts.
    Notices need five words.  Null and empty texts have none, long ones are
    read whole; repeated rows and null ids are kept; an empty table gives no
    rows.  Only id and text are read.
    """
    by_class, known, hashes = _literals(docs, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.lower(whole_text()), _SPLIT.replace("\\\\", "\\")).alias("w"))
    rows = rows.select("doc_id", F.expr("filter(w, x -> x <> '')").alias("w"))
    hashed = f"CASE WHEN size(w) >= {WORDS} THEN transform(sequence(0, size(w) - {WORDS}), i -> {_hash('w', 'i')}) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    rows = rows.select("doc_id", "w", F.expr(hashed).alias("h"))
    # a band can only agree on a shingle of a template, so other texts have no window to look at
    rows = rows.withColumn("some", F.expr(f"arrays_overlap(h, {_longs(hashes)})"))
    found = []
    for window, literal in by_class.items():
        windows = f"transform(sequence(0, greatest(size(h) - 1, 0), {window}), s -> struct(s AS s, slice(h, s + 1, {2 * window - WORDS + 1}) AS rows))"
        signed = f"filter({windows}, x -> arrays_overlap(x.rows, {_longs(hashes)}))"
        agree = f"exists(transform(p.bands, (v, b) -> v = {_least('x', 'b + 1').replace('x_rows', 'x.rows')}), same -> same)"
        found.append(
            f"flatten(transform({signed}, x -> transform(filter({literal}, p -> {agree}), p -> struct(p.template AS template, greatest(x.s - p.at - {window}, 0) AS first, {window} AS margin))))"
        )
    region = "slice(w, c.first + 1, t.n + 3 * c.margin)"
    shingle = f"transform(sequence(0, size(r) - {WORDS}), i -> concat_ws(' ', slice(r, i + 1, {WORDS})))"
    verified = f"""transform(array_distinct(concat({', '.join(found)})), c ->
        transform(array({known}[c.template]), t ->
          transform(array({region}), r ->
            transform(array(CASE WHEN size(r) >= {WORDS} THEN {shingle} ELSE CAST(array() AS ARRAY<STRING>) END), g -> struct(
              t.name AS name, t.n AS n, c.template AS template, t.before AS before,
              forall(t.required, p -> contains(concat(' ', array_join(r, ' '), ' '), p)) AS worded,
              CAST(size(array_intersect(t.shingles, g)) AS DOUBLE) / size(t.shingles) AS share,
              c.first + array_min(transform(t.shingles, x -> nullif(CAST(array_position(g, x) AS INT), 0))) - 1 AS word)))[0][0])[0])"""
    kept = f"CASE WHEN some THEN filter({verified}, m -> m.worded AND m.share >= {CONTAINED - 1e-9}) END"
    rows = rows.select("doc_id", F.expr(kept).alias("m"))
    longest = "filter(m, x -> NOT exists(m, y -> array_contains(y.before, x.template) AND y.word <= x.word + x.n AND x.word <= y.word + y.n))"
    rows = rows.select("doc_id", F.expr(longest).alias("m"))
    best = "transform(array_sort(array_distinct(transform(m, x -> x.name))), n -> array_sort(transform(filter(m, x -> x.name = n), x -> struct(-x.share AS less, x.word AS word, n AS name)))[0])"
    rows = rows.select("doc_id", F.expr(f"coalesce({best}, CAST(array() AS ARRAY<STRUCT<less: DOUBLE, word: INT, name: STRING>>))").alias("b"))
    return rows.select(
        "doc_id",
        F.expr("array_join(transform(b, x -> x.name), ',')").alias("licenses"),
        F.expr("array_join(transform(b, x -> concat_ws(':', x.name, x.word, CAST(round(-x.less, 3) AS STRING))), ',')").alias("matches"),
    )
