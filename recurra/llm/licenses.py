"""Licence scan: lines and blocks of text against licence templates, by Dice coefficient over word bigrams.

Texts are normalised (A-Z as a-z, "licence" as "license", words of letters a-z and digits) and compared as sets of
word bigrams. 2|A and B| / (|A| + |B|) can reach t only if the smaller set has at least t / (2 - t) times the size
of the larger one, so templates outside these bounds are not compared at all, nor are those that share no bigram.

Searched are lines, blocks split at two line feeds, and passages: any runs of words, whatever line ends, comment marks
or other words stand around them.

* Null, empty and one-word segments match nothing. A null doc_id is carried through. Repeated rows and repeated lines
  are reported each. Equal coefficients go to the name that sorts first. An empty table gives an empty result.
* Very long texts are handled whole; a segment that has more words than any bound allows may still match if they repeat.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of licences and the wording they are usually stated by.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.7
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[a-z0-9]+")
RESULT = "doc_id long, unit string, place long, license string, dice double"


def bigram_list(text: str) -> list[tuple[str, str]]:
    words = WORD.findall(text.translate(UPPER).replace("licence", "license"))
    return list(zip(words, words[1:]))


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    return frozenset(bigram_list(text))


class Matcher:
    """Templates by size, and which words begin to look like one."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = sorted(((name, bigrams(text)) for name, text in templates), key=lambda t: (t[0], len(t[1]), sorted(t[1])))
        self.known = frozenset().union(*(s for _, s in self.sets))
        ratio = threshold / (2 - threshold)
        self.bounds = [(len(s) * ratio, len(s) / ratio) for _, s in self.sets]

    def best(self, segment: str) -> tuple[str, float] | None:
        """The licence whose wording a segment repeats best, if well enough."""
        found = bigrams(segment)
        shared = found & self.known
        if not shared:
            return None
        best = None
        for (name, own), (least, most) in zip(self.sets, self.bounds):
            if least <= len(found) <= most:
                dice = round(2 * len(shared & own) / (len(found) + len(own)), 6)
                if dice >= self.threshold and (best is None or dice > best[1]):
                    best = (name, dice)
        return best

    def possible(self, line: list[tuple[str, str]]) -> list[tuple[str, frozenset, float]]:
        """Templates of which a text with these bigrams has enough for a line, block or passage, and the largest size."""
        present = self.known.intersection(line)
        return [
            (name, own, most)
            for (name, own), (least, most) in zip(self.sets, self.bounds)
            if present and len(present & own) >= math.ceil(least - 1e-9)
        ]

    def passages(self, text: str) -> list[tuple[int, str, float]]:
        """(first word, license, dice) of the runs of words that repeat a wording best, without overlap.

        A best run begins and ends with a bigram of the template. One whose first bigram comes again within it is no
        better than the run without that word, so longer ones need not be tried.
        """
        line = bigram_list(text)
        found = []
        for name, own, most in self.possible(line):
            for start in (k for k, g in enumerate(line) if g in own):
                seen, shared, best = set(), 0, None
                for stop in range(start, len(line)):
                    g = line[stop]
                    if stop > start and g == line[start]:
                        break
                    if g in seen:
                        continue
                    seen.add(g)
                    if len(seen) > most + 1e-9:
                        break
                    if g in own:
                        shared += 1
                        dice = round(2 * shared / (len(seen) + len(own)), 6)
                        if dice >= self.threshold and (best is None or dice > best[0]):
                            best = (dice, stop)
                if best:
                    found.append((-best[0], name, start, best[1]))
        kept: list[tuple[int, int, str, float]] = []
        for negative, name, start, stop in sorted(found):
            at = bisect.bisect(kept, (start,))
            # words start..stop+1 are covered
            if (at == len(kept) or kept[at][0] > stop + 1) and (at == 0 or kept[at - 1][1] < start):
                kept.insert(at, (start, stop + 1, name, -negative))
        return [(start, name, dice) for start, _, name, dice in kept]


def segments(text: str) -> Iterator[tuple[str, int, str]]:
    """(unit, place, text): every line, and every block of several lines between empty ones."""
    for place, line in enumerate(text.split("\n")):
        yield "line", place, line
    for place, block in enumerate(text.split("\n\n")):
        if "\n" in block:
            yield "block", place, block


def _scan(docs: DataFrame, templates, threshold: float, search) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows += [(doc_id, *row) for row in search(matcher, text.as_py() or "")]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(columns, kinds)], ["doc_id", "unit", "place", "license", "dice"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


UNITS = ("line", "block", "passage")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, units: tuple[str, ...] = UNITS[:2]) -> DataFrame:
    """(doc_id, unit, place, license, dice) of every line and block of docs(doc_id, text) that states a licence.

    ``units`` names what is searched: lines and blocks, placed by their number, or passages, by their first word's index.
    """

    def search(matcher: Matcher, text: str) -> Iterator[tuple]:
        if not matcher.possible(bigram_list(text)):
            return
        for unit, place, segment in segments(text):
            if unit in units and (found := matcher.best(segment)):
                yield unit, place, *found
        if "passage" in units:
            for place, name, dice in matcher.passages(text):
                yield "passage", place, name, dice

    return _scan(docs, templates, threshold, search)


def scan_passages(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The passages of ``scan`` alone."""
    return scan(docs, templates, threshold, ("passage",))
