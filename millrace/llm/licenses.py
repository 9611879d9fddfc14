"""Licence scans: sparse TF-IDF cosine of header windows and licence files to templates, then inheritance from the nearest directory.

All of it is DataFrame functions. A text is the sequence of its words: line breaks and comment marks are no
words, so wrapped headers and sentences within long lines count alike. Each template has marks that
tell its licence apart: a phrase and further words. Wherever the phrase stands in a text, the window of the
template's length that has the phrase at the template's place is compared; a window without the further
words is not. Titles count at the start of a text only. Files called like LICENSE or COPYING are compared as a whole too, with
full licence texts (``licence_texts`` and TEXTS). Texts that lack a mark as a substring are not split.

Distinct windows are weighed once: document frequencies of all their words and the templates' come from one
aggregation over the distinct words of all texts. Weights: (1 + ln tf) * idf, idf = 1 + ln((N + 1) / (df + 1)).
The best window names the file's own licence. Licence files speak for their directory; other files
without an own licence take that of the nearest directory above, by joins on distinct directories.

Results. A null or empty text has no own licence; a null path inherits nothing and speaks for nothing; ties between
templates go to the larger name, between licence files of a directory to the larger name too. Repeated rows
each get their row. Very long texts, and texts of one line, are read whole. The result has its six columns only:
further columns of files are dropped, and their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import cut, quoted

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU{} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: Header sentences that the licences prescribe or that are in common use, and their marks: a phrase of the template, then words that its window must hold.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "3")),
    ("AGPL-3.0", _GPL.format(" Affero", 3), ("gnu affero general public license", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2.0")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ("apache license", "2.0")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "permitted")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4.0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("by-nc 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("by-sa 4.0",)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "2")),
    ("GPL-2.0", _GPL.format("", 2), ("gnu general public license", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "3")),
    ("GPL-3.0", _GPL.format("", 3), ("gnu general public license", "3")),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "permission")),
    ("LGPL-2.1", _GPL.format(" Lesser", "2.1"), ("gnu lesser general public license", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "3")),
    ("LGPL-3.0", _GPL.format(" Lesser", 3), ("gnu lesser general public license", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "permission")),
    ("MIT", "Released under the MIT License", ("mit license",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2.0")),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered",)),
)
#: Titles, within the first ``_TITLE`` words of a text.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_MIT = """MIT License Copyright (c)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License Copyright (c)
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Full texts: licence, text or None for the file in ``licence_texts``, phrases that a whole file must hold.
TEXTS = (
    ("Apache-2.0", None, ("apache license version 2.0",)),
    ("BSD-3-Clause", None, ("redistribution and use", "endorse or promote")),
    ("CC0-1.0", None, ("cc0",)),
    ("GPL-1.0", None, ("gnu general public license version 1",)),
    ("GPL-2.0", None, ("gnu general public license version 2",)),
    ("GPL-3.0", None, ("gnu general public license version 3",)),
    ("ISC", _ISC, ("with or without fee",)),
    ("LGPL-2.1", None, ("gnu lesser general public license version 2.1",)),
    ("LGPL-3.0", None, ("gnu lesser general public license version 3",)),
    ("MIT", _MIT, ("free of charge",)),
    ("MPL-2.0", None, ("mozilla public license version 2.0",)),
)
_TITLE = 8
SALTS = 16
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"({_TERM})"), F.lit(1))


def _holds(low: Column, marks) -> Column:
    """Whether text holds all words of the marks, as substrings at least."""
    found = F.lit(True)
    for word in sorted({w for m in marks for w in m.split()}, key=len, reverse=True):
        found = found & F.contains(low, F.lit(word))
    return found


def _windows(low: Column, speaks: Column, headers, texts) -> Column:
    """array of struct(k, window): what of a text is to be compared with template k; null if nothing can be."""
    full = [(k, marks) for k, (_, _, marks) in enumerate(texts, len(headers))]
    possible, whole = F.lit(False), F.lit(False)
    for _, _, marks, _ in headers:
        possible = possible | _holds(low, marks)
    for _, marks in full:
        whole = whole | _holds(low, marks)
    joined = lambda w: F.array_join(w, " ")
    inside = lambda text, marks: [F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {m} ")) for m in marks]
    both = lambda tests: F.coalesce(_every(tests), F.lit(False))

    def cuts(w, k, text, marks, title):
        own, phrase = terms(text), marks[0].split()
        off = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        last = F.least(F.size(w), F.lit(_TITLE)) if title else F.size(w)
        at = F.filter(F.sequence(F.lit(0), last - 1), lambda i: both([F.get(w, i + j) == x for j, x in enumerate(phrase)]))
        start = lambda i: F.greatest(i - off, F.lit(0))
        found = F.transform(at, lambda i: joined(F.slice(w, start(i) + 1, i - off + len(own) - start(i))))
        return F.transform(F.filter(found, lambda x: both(inside(x, marks))), lambda x: F.struct(F.lit(k).alias("k"), x.alias("window")))

    def all_of(w):
        parts = [F.when(_holds(low, marks), cuts(w, k, text, marks, title)) for k, (_, text, marks, title) in enumerate(headers)]
        parts += [F.when(speaks & _holds(low, marks), _let(joined(w), lambda x: F.when(_every(inside(x, marks)), F.struct(F.lit(k).alias("k"), x.alias("window"))))) for k, marks in full]
        none = F.array().cast("array<struct<k:int,window:string>>")
        parts = [F.coalesce(p, none) for p in parts[: len(headers)]] + [F.coalesce(F.array_compact(F.array(p)), none) for p in parts[len(headers) :]]
        return F.array_distinct(F.concat(*parts))

    return F.when(possible | speaks & whole, _let(_split(low), lambda w: F.when(F.size(w) > 0, all_of(w))))


def _every(tests: list[Column]) -> Column:
    found = F.lit(True)
    for t in tests:
        found = found & t
    return found


def _weighed(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """counts (.., term, tf) with the weight w."""
    return counts.join(F.broadcast(idf), "term").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))


def _scores(lowered: DataFrame, n: int, windows: DataFrame, names: list[str], texts: list[str]) -> DataFrame:
    """(k, window, score, license) of distinct windows."""
    rows = [{"k": k, "term": t, "tf": tf} for k, text in enumerate(texts) for t, tf in Counter(terms(text)).items()]
    once = lowered.sparkSession.range(1)
    table = lambda data, kind: once.select(F.inline(F.from_json(F.lit(json.dumps(data)), kind)))
    known = table(rows, "array<struct<k:int,term:string,tf:bigint>>")
    held = windows.select("n", "k", F.explode(F.split("window", " ")).alias("term")).groupBy("n", "k", "term").agg(F.count("*").alias("tf"))
    vocabulary = held.select("term").union(known.select("term")).distinct()
    df = lowered.select(F.explode(F.array_distinct(_split(F.col("low")))).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = cut(vocabulary.join(df, "term", "left").select("term", (1 + F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("idf")))
    template = _weighed(known, idf)
    length = template.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    template = template.join(length, "k").select("k", "term", (F.col("w") / F.col("length")).alias("v"))
    dots = _weighed(held, idf).join(F.broadcast(template), ["k", "term"], "left").groupBy("n").agg((F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    named = table([{"k": k, "license": name} for k, name in enumerate(names)], "array<struct<k:int,license:string>>")
    return windows.join(dots, "n").join(F.broadcast(named), "k").select("k", "window", F.least("score", F.lit(1.0)).alias("score"), "license")


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """(id, path, own_license, own_score, license, inherited_from) for each row of files."""
    headers = [(*t, False) for t in templates] + [(name, title, (" ".join(terms(title)),), True) for name, title in TITLES]
    texts = [(name, text or (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(), marks) for name, text, marks in TEXTS]
    low = F.lower(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    lowered = files.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(path_col)).cast("string").alias("path"), low.alias("low"))
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    marked = lowered.withColumns({"folder": folder, "speaks": F.coalesce(F.element_at(parts, -1).rlike(_LICENCE_FILE), F.lit(False))})
    # A checkpoint holds the row numbers, so that they stay what they are.
    own = cut(marked.select("id", "path", "folder", "speaks", _windows(F.col("low"), F.col("speaks"), headers, texts).alias("windows"), F.monotonically_increasing_id().alias("row")))
    held = own.where("size(windows) > 0").select("row", F.inline("windows"))
    windows = cut(held.select("k", "window").distinct().withColumn("n", F.monotonically_increasing_id()))
    scores = _scores(lowered, own.count(), windows, [h[0] for h in headers] + [t[0] for t in texts], [h[1] for h in headers] + [t[1] for t in texts])
    best = held.join(scores, ["k", "window"]).where(F.col("score") >= threshold).groupBy("row").agg(F.max(F.struct("score", "license")).alias("best"))
    scored = cut(own.join(best, "row", "left").select("id", "path", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"), "folder", "speaks"))

    said = scored.where("speaks AND own_license IS NOT NULL").groupBy("folder").agg(F.max(F.struct("own_score", "own_license")).alias("s")).select(F.col("folder").alias("above"), F.col("s.own_license").alias("given"))
    folders = scored.where("own_license IS NULL AND path IS NOT NULL").select("folder").distinct()
    steps = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(steps, F.lit(1), n), "/")))
    # Folders above very many others, and folders of very many files, are met in SALTS tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    climbed = folders.select("folder", F.posexplode(F.array_distinct(up)).alias("depth", "above")).withColumn("salt", F.pmod(F.hash("folder"), F.lit(SALTS)))
    nearest = climbed.join(said.withColumn("salt", salts), ["above", "salt"]).groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    out = scored.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(nearest.withColumn("salt", salts), ["folder", "salt"], "left")
    inherits = F.col("own_license").isNull()
    return out.select(F.col("id").alias(id_col), "path", "own_license", "own_score", F.coalesce("own_license", "n.given").alias("license"), F.when(inherits, F.col("n.above")).alias("inherited_from"))
