"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's text is cut into statements (lines, and sentences in them); the statement closest to a template by the cosine of
sparse TF-IDF vectors decides the file's own licence, if the cosine reaches ``LEAST``. A licence
file gives its licence to its directory; a file without its own takes that of the nearest ancestor directory that has one, by an equality
join of the ancestors' paths.

Document frequencies of the template terms are counted over all statements of the corpus; any other term weighs like a term
seen once, so that a long statement that happens to hold a template's words stays far from it. What tasks share is
the templates and their terms' weights, bounded by the template list. Directories are resolved once each, whatever the
number of their files, so a directory with a third of all files is one row.

Edge cases: a null or empty text has no own licence; a null path has no directory and inherits nothing; of several licences in
one directory the most frequent wins, then the first by name; equal cosines go to the first template by name; a template with a version is met only by a statement with that version; every
row gets a row, so repeated rows get equal ones; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import small
from tagloom.session import stage

LEAST = 0.6
NOTICE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([._-].*)?$"
#: Usual short notices by licence; whole licence texts are not among them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Simplified BSD License"],
    "CC-BY-3.0": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "Licensed under CC BY 3.0."],
    "CC-BY-NC-3.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.", "Licensed under CC BY-NC 3.0."],
    "CC-BY-SA-3.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 3.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "Licensed under CC0 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: A text with the opening words that both BSD licences share and without this one's third clause, but with the second, is the shorter one.
BSD_SECOND, BSD_THIRD = (re.compile(r, re.I) for r in (r"binary form must reproduce", r"neither\W+the\W+names?\b|names? of .{0,200}may not be used to endorse"))
VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)*)")
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
TAG = re.compile(r"<[^>]*>")
CUT = re.compile(r"[\n\r]+|(?<=[.!?])\s+(?=[^\s0-9])")


def statements(text: str, markup: bool = False) -> list[list[str]]:
    """Terms of every statement."""
    if markup:
        text = html.unescape(TAG.sub("\n", HIDDEN.sub("\n", text)))
    cut = (TERM.findall(s.lower()) for s in CUT.split(text))
    return [s for s in cut if s]


def versions(terms: list[str]) -> frozenset[str]:
    """Version numbers among ``terms``, without zeros at the end."""
    return frozenset(re.sub(r"(\.0+)+$", "", m[1]) for t in terms if (m := VERSION.fullmatch(t)))


def vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {t for texts in templates.values() for x in texts for s in statements(x) for t in s}


def idf_weights(files: DataFrame, templates: dict[str, list[str]], markup: bool) -> tuple[dict[str, float], float]:
    """idf of the template terms over all statements, and of a term seen once."""
    known = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen: Counter = Counter()
            for text in batch.column(0):
                for terms in statements(text.as_py(), markup):
                    seen.update(known.intersection(terms))
                    seen[""] += 1  # statements
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    rows = files.where("text IS NOT NULL").select("text").mapInArrow(count, "term string, n long")
    df = {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = df.pop("", 0)
    return {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in known}, math.log((1 + total) / 2) + 1


def weighed(terms: list[str], idf: dict[str, float], rare: float) -> tuple[dict[str, float], float]:
    """Weights of the known terms and the length of the whole vector."""
    counts = Counter(terms)
    w = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in counts.items()}
    return {t: x for t, x in w.items() if t in idf}, math.sqrt(sum(x * x for x in w.values()))


def own_licences(
    files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, markup: bool = False
) -> DataFrame:
    """``files(file, text, ...)`` -> the other columns, licence (null below ``least``) and score of the closest statement, a row for each row."""
    templates = templates or TEMPLATES
    idf, rare = idf_weights(files, templates, markup)
    index: dict[str, list[tuple[int, float]]] = {}
    names, needs = [], []
    for name in sorted(templates):
        for text in templates[name]:
            w, length = weighed([t for s in statements(text) for t in s], idf, rare)
            for t, x in w.items():
                index.setdefault(t, []).append((len(names), x / length))
            names.append(name)
            needs.append(versions([t for s in statements(text) for t in s]))
    kept = files.drop("text")

    def closest(text: str | None) -> tuple[str | None, float]:
        best, who = 0.0, None
        found = statements(text or "", markup)
        for at, terms in enumerate(found):
            if index.keys().isdisjoint(terms):
                continue
            w, length = weighed(terms, idf, rare)
            dots: dict[int, float] = {}
            for t, x in w.items():
                for k, y in index[t]:
                    dots[k] = dots.get(k, 0.0) + x * y
            if max(dots.values()) / length <= best + 1e-12:
                continue
            # a notice in several lines has its version in the next one, or in that before
            own = versions(terms) or versions([t for s in found[max(at - 1, 0):at + 2] for t in s])
            k = max((k for k in dots if needs[k] <= own), key=lambda k: (dots[k], -k), default=None)
            if k is not None and dots[k] / length > best + 1e-12:
                best, who = dots[k] / length, names[k]
        if who == "BSD-3-Clause" and BSD_SECOND.search(text) and not BSD_THIRD.search(text):
            who = "BSD-2-Clause"
        return (who if best >= least else None), best

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [closest(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[:-1], "licence", "score"],
            )

    return files.select(*kept.columns, "text").mapInArrow(scan, kept.schema.add("licence", "string").add("score", "double"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_notice(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(NOTICE_NAME), F.lit(False))


def directory_licences(notices: DataFrame) -> DataFrame:
    """``notices(dir, licence)`` -> the most frequent licence of every directory."""
    counts = notices.where("dir IS NOT NULL AND licence IS NOT NULL").groupBy("dir", "licence").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "licence")).alias("_m")).select("dir", "_m.licence")


def inherited(dirs: DataFrame, licences: DataFrame) -> DataFrame:
    """``dirs(dir)``, ``licences(dir, licence)`` -> dir, licence, licence_dir and levels up to it."""
    parts = F.split("dir", "/")
    # from 0, as the root, the empty path, is above every directory
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"), (F.size(parts) - k).alias("levels")))
    each = dirs.where("dir IS NOT NULL").distinct().select("dir", F.inline(above))
    return (
        each.join(licences.select(F.col("dir").alias("up"), "licence"), "up")
        .groupBy("dir").agg(F.min(F.struct("levels", "up", "licence")).alias("_m"))
        .select("dir", "_m.licence", F.col("_m.up").alias("licence_dir"), "_m.levels")
    )


def scan(files: DataFrame, notice: Column | None = None, markup: bool = False) -> DataFrame:
    """``files(file, path, text)`` -> file, path, own_licence, score, licence, licence_dir, levels (null: own licence or none).

    ``notice``: which files speak for their directory (a condition on path and own_licence); by default those named as licence files.
    """
    own = own_licences(files.select("file", "path", "text"), markup=markup)
    rows = stage(own.select("file", "path", F.col("licence").alias("own_licence"), "score"))
    rows = rows.withColumn("dir", directory(F.col("path")))
    speaks = rows.where(is_notice(F.col("path")) if notice is None else notice)
    from_above = inherited(rows.select("dir"), directory_licences(speaks.select("dir", F.col("own_licence").alias("licence"))))
    alone = F.col("own_licence").isNull()
    return rows.join(from_above, "dir", "left").select(
        "file", "path", "own_licence", "score", F.coalesce("own_licence", "licence").alias("licence"),
        F.when(alone, F.col("licence_dir")).alias("licence_dir"), F.when(alone, F.col("levels")).alias("levels"),
    )


def query(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every page and every document: origin (the table), file (its id), path and what ``scan`` says of it.

    A page lies at its url, and every page with a statement speaks for its directory, as sites have no licence files. A document
    lies in its source; as it is no licence file, its statement speaks for itself alone.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$|/+$", "")
    path = F.when(path.contains("/"), path).otherwise(F.concat(path, F.lit("/")))  # a home page lies in its host
    files = pages.select(F.col("page_id").cast("string").alias("file"), path.alias("path"), F.col("html").alias("text"))
    of_pages = scan(files, F.col("own_licence").isNotNull(), markup=True)
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    texts = documents.select(F.col("doc_id").cast("string").alias("file"), name.alias("path"), "text")
    return of_pages.select(F.lit("pages").alias("origin"), "*").union(scan(texts).select(F.lit("documents"), "*"))
