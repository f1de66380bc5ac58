"""License scan: sparse TF-IDF cosine to templates, then inheritance down the directories.

Terms are weighted by their document frequency over the whole corpus.  Every
line of a file is compared with the templates; a licence file is compared as a
whole too.  A file without a licence of its own takes that of
the nearest directory above it that holds a licence file, found by joining its
ancestor paths with the directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, spread_join, table

SIMILAR = 0.7
#: Public licence notices, by licence.
TEMPLATES = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "BSL": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under the Creative Commons CC0 Universal Public Domain Dedication.",
    ],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: No licence but a notice that none is given; it counts where a file has no other.
RESERVED = "Proprietary"

_TERM = re.compile(r"[a-z]+")
_VERSION = re.compile(r"\d+(?:\.\d+)*")


def terms_of(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({t for texts in templates.values() for text in texts for t in terms_of(text)})


class Matcher:
    """Cosine of lines to templates; lines that cannot reach the threshold are passed over."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], unknown: float, similar: float):
        self.idf, self.unknown, self.similar = idf, unknown, similar
        self.templates = []
        strong: set[str] = set()
        for name, texts in sorted(templates.items()):
            for text in texts:
                v = self.vector(terms_of(text))
                self.templates.append((name, v))
                # A unit vector without these terms has less than the threshold in common.
                rest = 0.0
                for t, w in sorted(v.items(), key=lambda x: (x[1], x[0])):
                    rest += w * w
                    if rest >= similar * similar * 0.999:
                        strong.add(t)
        self.strong = frozenset(strong)

    def vector(self, terms: Counter) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.unknown) for t, n in terms.items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {t: w / norm for t, w in v.items()}

    def best(self, text: str) -> tuple[str | None, float]:
        terms = terms_of(text)
        if self.strong.isdisjoint(terms):
            return None, 0.0
        v = self.vector(terms)
        score, name = max((sum(w * v.get(t, 0.0) for t, w in template.items()), name) for name, template in self.templates)
        return (name, score) if score >= self.similar else (None, 0.0)

    def of_file(self, text: str, whole: bool) -> tuple[str | None, float, str | None]:
        """Best (licence, cosine, version) among the lines, and the whole text if ``whole``; the first among equals.

        Reserved rights come last: they often stand above the licence proper.
        """
        found: tuple[str | None, float, str | None] = (None, 0.0, None)
        if self.strong.isdisjoint(_TERM.findall(text.lower())):
            return found
        for unit in [*text.split("\n"), *([text] if whole else [])]:
            name, score = self.best(unit)
            over = (name != RESERVED, score) > (found[0] != RESERVED, found[1] + 1e-12)
            if name and (found[0] is None or over):
                number = _VERSION.search(unit)
                found = (name, score, number.group() if number else None)
        return found


def _document_frequency(terms: list[str]):
    known = set(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for rows in batches:
            for text in rows["text"]:
                seen.update(known.intersection(_TERM.findall((text or "").lower())))
                seen[""] += 1
        if seen:
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return run


def _own_licences(matcher: Matcher):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [matcher.of_file(t or "", w) for t, w in zip(rows["text"], rows["is_licence_file"])]
            out = rows[["doc_id", "path", "is_licence_file"]].copy()
            out["license"], out["similarity"], out["version"] = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]
            yield out

    return run


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """Licence of every row of (doc_id, path, text, is_licence_file).

    Returns doc_id, path, license, similarity, version, via (``own``,
    ``reserved``, ``directory`` or null), from_path.  A file that only reserves
    its rights is proprietary (``reserved``) and inherits nothing.  Null and empty texts have no licence of
    their own; a row without path inherits nothing and passes nothing on; of
    several licence files in a directory the most similar counts, then the first
    path; repeated rows are judged alike.  An empty table gives no rows; other
    columns are ignored.
    """
    files = files.select("doc_id", "path", "text", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"))
    terms = vocabulary(templates)  # bounded by the templates
    counted = files.select("text").mapInPandas(_document_frequency(terms), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}
    total = df.pop("", 0)
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in terms}
    matcher = Matcher(templates, idf, math.log(total + 1) + 1, similar)
    own = settled(files.mapInPandas(
        _own_licences(matcher),
        "doc_id long, path string, is_licence_file boolean, license string, similarity double, version string",
    ), "own-licences")

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("p"))
    folders = own.where("is_licence_file AND license IS NOT NULL AND path IS NOT NULL").groupBy(folder.alias("_folder")).agg(
        F.min_by(F.struct("license", "version", "path"), rank).alias("_given")
    )
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    bare = own.where("license IS NULL AND path IS NOT NULL").select("path").distinct()
    asked = bare.select("path", F.posexplode(above).alias("_depth", "_folder"))
    nearest = spread_join(asked, folders, ["_folder"], ["path"], "inner").groupBy("path").agg(F.max_by("_given", "_depth").alias("_given"))
    judged = spread_join(own, nearest, ["path"], ["doc_id"])
    mine = F.col("license").isNotNull()
    return judged.select(
        "doc_id", "path", F.coalesce("license", "_given.license").alias("license"), "similarity",
        F.when(mine, F.col("version")).otherwise(F.col("_given.version")).alias("version"),
        F.when(F.col("license") == RESERVED, "reserved").when(mine, "own").when(F.col("_given").isNotNull(), "directory").alias("via"),
        F.when(mine, F.col("path")).otherwise(F.col("_given.path")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files; the table has no paths, so they get one from source, language and id.

    Files lie one to three folders deep.  The ids also say which files stand for
    their folder's licence file: one in 64 in folders of each depth.
    """
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", F.when(i % 4 != 0, F.col("lang")), F.when(i % 4 > 1, F.floor(i / 256)), i.cast("string"))
    return docs.select("doc_id", F.when(i.isNotNull(), path).alias("path"), "text", (i % 64).isin(0, 1, 3).alias("is_licence_file"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, own or inherited."""
    return scan_licenses(document_files(table(spark, sf_dir, "documents")))
