"""Licence scan: windows of normalised words against licence templates by the Dice coefficient of their word bigrams.

A text is read as words of letters and digits without case. Every window of a template's length (shorter at the text's end)
is compared with it as sets of bigrams. A template is passed over for a text only where sizes rule the similarity out: the whole
text holds too few of its bigrams. Elsewhere running sums give the coefficient of all windows in time linear in the text.
The best window of a place counts if it also names the licence: notices that differ in a version or family word are not each other's.

Defined cases: null and empty texts hold no licence; of windows of one licence that overlap the best counts, the first of equal
ones; equal rows each give their rows; a null doc_id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import flat, ngrams, owner, pieces
from barloom.llm.decontaminate import Vocabulary, plain_spans, plain_words

DICE = 0.7

# Names by SPDX and the notices that works carry under these licences; then whole licence texts.
# Whether later versions are allowed is not told apart. AGPL-3.0 is the text of GPL-3.0 with the passages that differ written in.
BODIES = ("AGPL-3.0", "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC",
          "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense")
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"""This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {family} as published by the
Free Software Foundation; either version {version} of the License, or (at your option) any later version.""") for name, work, family, version in (
        ("GPL-1.0", "program", "General Public License", "1"), ("GPL-2.0", "program", "General Public License", "2"),
        ("LGPL-2.0", "library", "Library General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"))),
    *((f"{short}-{version}.0", f"This {work} is licensed under the GNU {family} General Public License, version {version}.") for short, work, family, version in (
        ("LGPL", "library", "Library", "2"), ("GPL", "work", "", "1"))),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"""),
    *((f"CC-BY-{kind}-4.0", f"Licensed under CC BY-{kind} 4.0.") for kind in ("ND", "NC-SA", "NC-ND")),
    *((f"CC-BY-{kind}-4.0", f"This work is licensed under a Creative Commons Attribution-{words} 4.0 International License.") for kind, words in (
        ("ND", "NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"), ("NC-ND", "NonCommercial-NoDerivatives"), ("SA", "Share Alike"), ("NC", "Non-Commercial"),
        ("ND", "No Derivatives"), ("NC-SA", "Non-Commercial-Share Alike"), ("NC-ND", "Non-Commercial-No Derivatives"))),
    *((name, files(__package__).joinpath(f"license_texts/{name}.txt").read_text(encoding="utf-8")) for name in BODIES),
)

# A notice must hold its template's family words and version, and no other family's; of a body, whose text names other licences, only the title counts.
FAMILY = ("affero", "lesser", "mit", "apache", "mozilla", "eclipse", "bsd", "isc", "noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs",
          "derivatives", "derivs", "nc", "sa", "nd")
BODY, TITLE = 100, 12  # words


def bigrams(words: np.ndarray) -> np.ndarray:
    return ngrams(words, np.array([0, len(words)]), 2)[0]


def previous(values: np.ndarray) -> np.ndarray:
    """The place of the same value before each place, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, dtype=np.int64)
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def named(words: list[str | None]) -> tuple[set[str], set[tuple[str, ...]]]:
    """The family words and the versions, without a closing 0, that words name."""
    family = {w for w in words if w in FAMILY} | {"gnu library" for a, b in zip(words, words[1:]) if (a, b) == ("gnu", "library")}
    versions = set()
    for i, w in enumerate(words):
        if w in ("version", "v"):
            run = tuple(itertools.takewhile(lambda x: x is not None and x.isdigit(), words[i + 1 :]))
            versions.add(run[:-1] if len(run) > 1 and run[-1] == "0" else run)
    return family, versions - {()}


class Apart:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take the span in unless it overlaps one that is here."""
        k = bisect.bisect_right(self.ends, start)
        if k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


@dataclass
class Templates:
    """The bigrams of all templates."""

    names: list[str]
    words: list[int]
    sets: list[np.ndarray]
    vocabulary: Vocabulary
    # of each known bigram: the templates that hold it, as one run
    first: np.ndarray
    template: np.ndarray
    dice: float
    # words that tell licences apart, by hash; of each template: its family words and versions, and what a notice cannot lack
    marks: dict[int, str]
    named: list[tuple[set[str], set[tuple[str, ...]]]]
    needs: list[set[str]]
    titles: list[np.ndarray]

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...], dice: float) -> Templates:
        hashes, at = plain_words(pa.array([t for _, t in templates], pa.string()))
        lists = [hashes[a:b] for a, b in zip(at[:-1], at[1:])]
        if min(map(len, lists), default=2) < 2:
            raise ValueError("a template needs two words")
        sets = [np.unique(bigrams(w)) for w in lists]
        key = np.concatenate(sets)
        which = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
        order = np.lexsort((which, key))
        known = Vocabulary(key)
        listed = [*FAMILY, "gnu", "library", "version", "v", *map(str, range(100))]
        marks = dict(zip(plain_words(pa.array(listed))[0].tolist(), listed))
        tell, needs = [], []
        for (name, _), words in zip(templates, lists):
            seen = [marks.get(h) for h in words.tolist()]
            tell.append(named(seen[:TITLE] if len(words) > BODY else seen))
            version = set(re.findall(r"(?<![A-Za-z\d])\d+", name)) - {"0"} if "Clause" not in name else set()
            needs.append({w for w in seen if w in FAMILY or w in version})
        return Templates([n for n, _ in templates], [len(w) for w in lists], sets, known,
                         np.append(np.searchsorted(key[order], known.keys), len(key)), which[order], dice, marks, tell, needs, [bigrams(w[:TITLE]) for w in lists])

    def near(self, gram: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) wherever the text holds as many of the template's bigrams as the least Dice needs."""
        hit, which = self.vocabulary.find(gram)
        own = np.unique(owner(first, int(first[-1]))[at[hit]] * len(self.vocabulary.keys) + which)
        text, which = np.divmod(own, max(len(self.vocabulary.keys), 1))
        count = self.first[which + 1] - self.first[which]
        entry = np.repeat(self.first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key, held = np.unique(np.repeat(text, count) * len(self.sets) + self.template[entry], return_counts=True)
        # Dice is 2 * shared / (sum of sizes), and no window holds fewer bigrams than it shares
        least = self.dice / (2 - self.dice) * np.array([len(s) for s in self.sets])
        return [divmod(k, len(self.sets)) for k in key[held >= least[key % len(self.sets)] - 1e-9].tolist()]

    def windows(self, gram: np.ndarray, before: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, Dice) of every window of a text that is like template t; before: the place of the same bigram before, or -1."""
        size, place = self.words[t] - 1, np.arange(len(gram))
        # a window's first of each bigram counts: the one at p does where the window begins after its last copy and reaches p
        low = np.maximum(before, place - size) + 1
        near = np.isin(gram, self.sets[t])
        shared = np.cumsum(np.bincount(low[near], minlength=len(gram) + 1) - np.bincount(place[near] + 1, minlength=len(gram) + 1))[:-1]
        distinct = np.cumsum(np.bincount(low, minlength=len(gram) + 1) - np.bincount(place + 1, minlength=len(gram) + 1))[:-1]
        value = 2 * shared / (distinct + len(self.sets[t]))
        begin = np.flatnonzero(value >= self.dice)
        return begin, value[begin]

    def means(self, t: int, words: np.ndarray, gram: np.ndarray, b: int, n: int) -> bool:
        """Whether the window of n words at b, like template t, names its licence and not one that differs in a version or family word."""
        body = self.words[t] > BODY
        if body:
            # the title, with a word more on either side, near the begin
            low = max(b - 4 * TITLE, 0)
            held = low + np.flatnonzero(np.isin(gram[low : b + 2 * TITLE], self.titles[t]))
            if not any(self.named[t]) or not len(held):
                return True
            seen = words[max(held[0] - 1, 0) : held[-1] + 3]
        else:
            # inserted words push others out of the window: as many more as it lacks, from the first to the last that the template has
            held = b + np.flatnonzero(np.isin(gram[b : b + n - 1], self.sets[t]))
            more = len(self.sets[t]) - len(np.unique(gram[held]))
            low = max(b - more, 0)
            held = low + np.flatnonzero(np.isin(gram[low : b + n - 1 + more], self.sets[t]))
            seen = words[held[0] : held[-1] + 2]
        seen = [self.marks.get(h) for h in seen.tolist()]
        family, versions = named(seen)
        if family - self.named[t][0] or versions and self.named[t][1] and not versions & self.named[t][1]:
            return False
        return body or self.needs[t] <= set(seen)

    def find(self, column: pa.Array) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, Dice coefficient, start, end in bytes) of the licences, apart from one another."""
        hashes, start, end, first = plain_spans(column)
        gram, at = ngrams(hashes, first, 2)
        if not len(gram):
            return []
        edge = np.searchsorted(at, first)
        # bodies and notices apart: a body that is another licence's does not hide the notices in it
        out: dict[tuple[int, str, bool], list[tuple[float, int, int, int]]] = {}
        last, own, before = -1, gram[:0], at[:0]
        for doc, t in self.near(gram, at, first):
            if doc != last:
                last, own = doc, gram[edge[doc] : edge[doc + 1]]
                before = previous(own)
            begin, value = self.windows(own, before, t)
            length = np.minimum(self.words[t], len(own) + 1 - begin)
            out.setdefault((doc, self.names[t], self.words[t] > BODY), []).extend(zip(value.tolist(), begin.tolist(), length.tolist(), [t] * len(begin)))
        made = []
        for (doc, name, body), windows in out.items():
            taken = Apart()
            for value, b, n, t in sorted(windows, key=lambda w: (-w[0], -w[2], w[1])):
                if taken.add(b, b + n) and self.means(t, hashes[first[doc] : first[doc + 1]], gram[edge[doc] : edge[doc + 1]], b, n):
                    made.append((doc, name, value, b, n, body))
        # a notice that names one licence is not also a weaker match of a similar one, nor a second find inside a whole text
        kept = []
        texts: dict[int, Apart] = {}
        for m in sorted(made, key=lambda m: (m[0], not m[5], -m[2], -m[4], m[1], m[3])):
            if texts.setdefault(m[0], Apart()).add(m[3], m[3] + m[4]):
                kept.append(m[:5])
        return [(d, name, value, int(start[first[d] + b]), int(end[first[d] + b + n - 1])) for d, name, value, b, n in sorted(kept, key=lambda m: (m[0], m[3], m[1]))]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, license, dice, start and end (code points, end exclusive) of every licence notice."""
    kind = docs.schema[doc_id].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(Templates.of(templates, dice))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = known.value.find(batch.column("text"))
            buf, offsets = flat(batch.column("text"))
            points = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
            spans = [(points[a] - points[offsets[d]], points[b] - points[offsets[d]]) for d, _, _, a, b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()),
                 pa.array([round(f[2], 6) for f in found], pa.float64()), *(pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1))],
                names=["doc_id", "license", "dice", "start", "end"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        rows, f"doc_id {kind}, license string, dice double, start long, end long")
