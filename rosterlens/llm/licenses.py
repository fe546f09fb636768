"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
import textwrap
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W
from rosterlens.session import staged

#: The usual words of headers and the first words of licence files, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)
#: Only lines with one of these and those around them are compared; every template has one, none of which a line's end parts.
CUES = (b"licen", b"permi", b"redistribut", b"domain", b"reserved", b"copyright")
#: Least cosine of a header, and of a whole text that is a licence file.
HEADER, FILE = 0.8, 0.6
#: Columns of the narrowest wrapped header, and ends of sentences in a header at most.
COLUMNS, SENTENCES = 50, 3
#: Names of licence files.
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"

_TERMS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*").findall


def terms(text: str) -> Counter:
    return Counter(_TERMS(text.lower()))


class Index:
    """Sparse TF-IDF vectors of the templates, as an inverted list for each term."""

    def __init__(self, templates=TEMPLATES):
        counted = [terms(t) for _, t in templates]
        df = Counter(x for c in counted for x in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {x: math.log((1 + len(templates)) / (1 + n)) + 1 for x, n in df.items()}
        self.names = [n for n, _ in templates]
        #: Lines of the longest template, and one more as it may begin within a line.
        self.span = 1 + max((len(textwrap.wrap(t, COLUMNS)) for _, t in templates), default=0)
        self.lists: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counted):
            norm = math.sqrt(sum((n * self.idf[x]) ** 2 for x, n in c.items()))
            for x, n in c.items():
                self.lists.setdefault(x, []).append((i, n * self.idf[x] / norm))

    def best(self, text: str) -> tuple[float, str | None]:
        """Cosine and name of the nearest template; of equal ones the first by name."""
        return self.nearest(terms(text))

    def nearest(self, counted: Counter) -> tuple[float, str | None]:
        dots: Counter = Counter()
        for x, n in counted.items():
            for i, weight in self.lists.get(x, ()):
                dots[i] += n * self.idf[x] * weight
        if not dots:
            return 0.0, None
        norm = math.sqrt(sum((n * self.idf.get(x, self.unseen)) ** 2 for x, n in counted.items()))
        cosine = max(dots.values())
        return round(cosine / norm, 6), min(self.names[i] for i, d in dots.items() if d >= cosine - 1e-12)


@cache
def _index(templates) -> Index:
    return Index(templates)


def _runs(parts: list[str], span: int) -> Iterator[Counter]:
    """Terms of every run of at most ``span`` parts that holds a cue."""
    cued = [any(c in p.lower().encode() for c in CUES) for p in parts]
    near = [any(cued[max(0, i - span + 1) : i + span]) for i in range(len(parts))]
    counted = [terms(p) if x else Counter() for p, x in zip(parts, near, strict=True)]
    for i in range(len(parts)):
        if any(cued[i : i + span]):
            held, cue = Counter(), False
            for j in range(i, min(i + span, len(parts))):
                held.update(counted[j])
                cue = cue or cued[j]
                if cue:
                    yield held


def passages(text: bytes, span: int) -> Iterator[Counter]:
    """Terms of what is compared: runs of lines around each cue, and runs of their pieces.

    Runs have at most ``span`` lines. Pieces end where a line or a sentence does, so a header may begin or end within
    a line. Each counter is the passage's until the next one is drawn.
    """
    low = text.lower()
    if not any(c in low for c in CUES):
        return
    whole = text.decode("utf-8", "replace")
    yield from _runs(whole.split("\n"), span)
    yield from _runs([p for p in re.split(r"\n|(?<=[.;])\s+", whole) if p.strip()], span + SENTENCES)


def _scan(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates)
        for batch in W.pieces(batches, "text"):
            rows = []
            for text in W.text_bytes(batch.column("text")):
                near = [index.nearest(p) for p in passages(text or b"", index.span)]
                header = max(near, key=lambda x: (x[0], x[1] or ""), default=(0.0, None))
                whole = index.best(text.decode("utf-8", "replace")) if near else (0.0, None)
                rows.append((header[1] if header[0] >= HEADER else None, header[0], whole[1], whole[0]))
            names = [c for c in batch.schema.names if c != "text"]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.float64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *columns], [*names, "header", "header_cosine", "whole", "whole_cosine"]
            )

    return run


def scanned(files: DataFrame, keep: list[str], templates=TEMPLATES) -> DataFrame:
    """``files(path, text, ...)``: path, ``keep``, the header's licence, and whether it is a licence file.

    A licence file is near a template as a whole, or has a licence file's name and a licence's header.
    """
    kept = ["path", *[c for c in keep if c != "path"]]
    found = files.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(
        _scan(templates), W.with_columns(files, kept, "header string, header_cosine double, whole string, whole_cosine double")
    )
    whole = F.col("whole_cosine") >= FILE
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    return found.select(
        *kept,
        F.when(whole, F.col("whole")).otherwise(F.col("header")).alias("license"),
        F.when(whole, F.col("whole_cosine")).otherwise(F.col("header_cosine")).alias("cosine"),
        (whole | (named & F.col("header").isNotNull())).alias("is_license_file"),
    )


def folder(path: str) -> F.Column:
    """What stands before the last slash; "" for none and for null."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/", 1), F.lit(""))


def inherited(found: DataFrame) -> DataFrame:
    """``scanned`` rows with license, origin (header, file, inherited, none) and origin_dir.

    A file without a licence of its own gets that of the nearest directory at or above its own that holds a
    licence file. A directory with several takes the one of the highest cosine, then of the first name.
    Directories are resolved once each, whatever number of files they hold: their prefixes are joined
    by path with the licensed directories, and the longest is taken. Files without path lie in the root.
    """
    rows = found.withColumn("dir", folder("path"))
    licensed = (
        rows.where("is_license_file")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license")).alias("best"))
        .select(F.col("dir").alias("origin_dir"), F.col("best.license").alias("given"))
    )
    open_dirs = rows.where("license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    prefixes = open_dirs.select(
        "dir",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(F.lit("")),
                    F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
                )
            )
        ).alias("origin_dir"),
    )
    nearest = (
        prefixes.join(licensed, "origin_dir")
        .groupBy("dir")
        .agg(F.max_by(F.struct("origin_dir", "given"), F.length("origin_dir")).alias("from"))
        .select("dir", "from.*")
    )
    own = F.col("license").isNotNull()
    origin = F.when(F.col("is_license_file"), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return (
        rows.join(nearest, "dir", "left")
        .withColumn("origin", origin)
        .withColumn("origin_dir", F.when(F.col("origin") == "inherited", F.col("origin_dir")))
        .withColumn("license", F.coalesce("license", "given"))
        .drop("dir", "given")
    )


def licenses(files: DataFrame, keep: list[str], templates=TEMPLATES) -> DataFrame:
    """One row per row of ``files(path, text, ...)``: path, ``keep``, license, cosine, is_license_file, origin, origin_dir.

    Null and empty texts have no licence of their own. An empty table gives no rows; equal rows give equal
    rows. Further columns are ignored.
    """
    return inherited(staged(scanned(files, keep, templates)))
