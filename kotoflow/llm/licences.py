"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

A text is compared with licence templates (short notices, file headers, whole
short licences and the opening words of long ones) as sparse TF-IDF vectors, in
three kinds of units: every line, every paragraph - so that a header that was
wrapped at any column is one unit -, and the whole text - so that a licence file
meets the whole licence.  The best unit names the licence.  A unit can only reach
the threshold if it holds one of a template's *heavy* terms - those whose absence
alone would leave too little weight - so other texts and units are skipped without
a comparison and without loss.

A file without a notice inherits from the nearest ancestor directory that holds
a licence file; directories are resolved once each and joined to files by path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotoflow.llm.common import write_table

THRESHOLD = 0.6
#: A text is itself a licence file from this share of words in matching lines (or by its name).
FILE_SHARE = 0.8

# Wording of published licences and of common references to them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights: CC0 1.0 Universal public domain dedication"),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited"),
]
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z0-9]{1,8})?$"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A paragraph ends at a line without words (comment marks aside).
_BLANK = r"\n[ \t\r*#/;%-]*\n"


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


class Matcher:
    """Best template of a line by TF-IDF cosine (idf over the templates; unseen terms weigh as if in none)."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, bags = threshold, [terms(t) for _, t in templates]
        n = len(bags)
        df = Counter(t for b in bags for t in b)
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
        self.unseen = math.log(1 + n) + 1
        self.names = [name for name, _ in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        heavy = set()
        for k, b in enumerate(bags):
            w = {t: c * self.idf[t] for t, c in b.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            rest = 1.0
            for t, x in sorted(w.items(), key=lambda y: (-y[1], y[0])):
                self.postings.setdefault(t, []).append((k, x / norm))
                # a line without the terms so far scores at most the length of what is left
                if rest > 0 and math.sqrt(rest) >= threshold * (1 - 1e-9):
                    heavy.add(t)
                rest -= (x / norm) ** 2
        self.gate = re.compile("|".join(sorted(map(re.escape, heavy), key=len, reverse=True)))

    def match(self, unit: str) -> tuple[float, str, int] | None:
        """(cosine, licence, terms of the unit), or None below the threshold.  Ties go to the template listed first."""
        low = unit.lower()
        if not self.gate.search(low):
            return None
        bag = terms(low)
        norm, dots = 0.0, {}
        for t, c in bag.items():
            x = c * self.idf.get(t, self.unseen)
            norm += x * x
            for k, w in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + x * w
        if not dots:
            return None
        k = max(dots, key=lambda k: (round(dots[k], 9), -k))
        cosine = dots[k] / math.sqrt(norm)
        return (cosine, self.names[k], sum(bag.values())) if cosine >= self.threshold else None

    def best(self, text: str | None) -> tuple[str | None, float | None, float]:
        """(licence, cosine, share of the text's terms in matching units of one kind) of a whole text."""
        if not text or not self.gate.search(text.lower()):
            return None, None, 0.0
        found, covered = [], 0
        for units in (text.split("\n"), re.split(_BLANK, text), [text]):
            own = [m for m in map(self.match, units) if m]
            covered = max(covered, sum(m[2] for m in own))
            found += own
        if not found:
            return None, None, 0.0
        score, name, _ = max(found, key=lambda m: (round(m[0], 9), m[1]))
        return name, round(score, 6), round(covered / max(1, sum(terms(text).values())), 6)


@lru_cache(maxsize=2)
def matcher(threshold: float) -> Matcher:
    return Matcher(threshold=threshold)


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per row: ``doc_id, path, licence, score, coverage, found_by, licence_dir``.

    ``found_by`` is ``own`` (a notice in the text), ``inherited`` (from
    ``licence_dir``) or null.  Of several licence files in one directory the
    commonest licence counts, ties to the smaller name.  Null texts and paths
    count as empty: no notice, directory ``""`` - the root, from which every
    path inherits.  Repeated rows are answered each; an empty table gives no
    rows; other columns are ignored.
    """

    def own(batches):
        m = matcher(threshold)
        for batch in batches:
            got = [m.best(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[i] for g in got], kind) for i, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.float64())))], names=["doc_id", "path", "licence", "score", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(path.cast("string"), F.lit("")), "/+", "/"), "^/", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), clean.alias("path"), F.col(text_col).cast("string").alias("text")).mapInArrow(own, f"doc_id {kind}, path string, licence string, score double, coverage double")
    # the texts are read once: what follows is small and read twice
    rows, _ = write_table(rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licences")
    files = rows.where(F.col("licence").isNotNull() & (F.col("path").rlike(_FILE_NAME) | (F.col("coverage") >= file_share)))
    votes = files.groupBy("dir", "licence").count()
    held = votes.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("count"), "licence")).alias("dir_licence"))
    # distinct directories without own notices, with all their ancestors; one row per directory is left
    wanted = rows.where(F.col("licence").isNull()).select("dir").distinct()
    up = wanted.select("dir", F.explode(F.expr("transform(sequence(0, if(dir = '', 0, size(split(dir, '/')))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")).alias("ancestor"))
    near = up.join(held.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_licence"), F.length("ancestor")).alias("near"))
    near, _ = write_table(near, "licence-dirs")
    out = rows.join(near, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("licence", "near.dir_licence").alias("licence"),
        "score",
        "coverage",
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").alias("found_by"),
        F.when(~mine, F.col("near.ancestor")).alias("licence_dir"),
    )



def oracle_sql(threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> str:
    """The query over ``documents`` in DuckDB's SQL: every unit against every template, no gate."""
    m = matcher(threshold)
    weights = ", ".join(f"({k}, '{t}', CAST({w!r} AS DOUBLE))" for t, rows in sorted(m.postings.items()) for k, w in rows)
    idf = ", ".join(f"('{t}', CAST({v!r} AS DOUBLE))" for t, v in sorted(m.idf.items()))
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate(m.names))
    return rf"""
WITH weight AS (SELECT * FROM (VALUES {weights}) AS v(k, term, w)), idf AS (SELECT * FROM (VALUES {idf}) AS v(term, idf)), name AS (SELECT * FROM (VALUES {names}) AS v(k, licence)),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, regexp_split_to_array(coalesce(text, ''), '{_BLANK}') AS p, [coalesce(text, '')] AS w FROM documents),
unit AS (SELECT doc_id, 0 AS kind, unnest(generate_series(1, len(l))) AS i, lower(unnest(l)) AS unit FROM cut UNION ALL SELECT doc_id, 1, unnest(generate_series(1, len(p))), lower(unnest(p)) FROM cut UNION ALL SELECT doc_id, 2, 1, lower(unnest(w)) FROM cut),
term AS (SELECT doc_id, kind, i, unnest(regexp_extract_all(unit, '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM unit),
total AS (SELECT doc_id, count(*) AS n FROM term WHERE kind = 2 GROUP BY doc_id),
bag AS (SELECT doc_id, kind, i, term, count(*) AS c FROM term GROUP BY ALL),
weighed AS (SELECT b.*, c * coalesce(idf, CAST({m.unseen!r} AS DOUBLE)) AS x FROM bag b LEFT JOIN idf USING (term)),
length AS (SELECT doc_id, kind, i, sqrt(sum(x * x)) AS norm, sum(c) AS terms FROM weighed GROUP BY ALL),
dot AS (SELECT doc_id, kind, i, k, sum(x * w) AS dot FROM weighed JOIN weight USING (term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, i ORDER BY round(dot, 9) DESC, k) AS r FROM dot),
found AS (SELECT b.doc_id, b.kind, dot / norm AS cosine, licence, terms FROM best b JOIN length USING (doc_id, kind, i) JOIN name USING (k) WHERE r = 1 AND dot / norm >= {threshold}),
own AS (SELECT doc_id, arg_max(licence, (round(cosine, 9), licence)) AS licence, round(arg_max(cosine, (round(cosine, 9), licence)), 6) AS score,
  greatest(sum(terms) FILTER (WHERE kind = 0), sum(terms) FILTER (WHERE kind = 1), sum(terms) FILTER (WHERE kind = 2)) AS terms FROM found GROUP BY doc_id),
file AS (SELECT d.doc_id, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, d.source AS dir, o.licence, o.score, CASE WHEN o.licence IS NULL THEN 0 ELSE round(o.terms / t.n, 6) END AS coverage
  FROM documents d LEFT JOIN own o USING (doc_id) LEFT JOIN total t USING (doc_id)),
vote AS (SELECT dir, licence, count(*) AS n FROM file WHERE licence IS NOT NULL AND coverage >= {file_share} GROUP BY ALL),
held AS (SELECT dir, arg_min(licence, (-n, licence)) AS dir_licence FROM vote GROUP BY dir)
SELECT doc_id, path, coalesce(f.licence, dir_licence) AS licence, score, CAST(coverage AS DOUBLE) AS coverage,
  CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' END AS found_by,
  CASE WHEN f.licence IS NULL AND dir_licence IS NOT NULL THEN dir END AS licence_dir
FROM file f LEFT JOIN held USING (dir)
"""
