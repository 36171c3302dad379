"""License scans by conditional compression.

Words of whole texts are compared across line and sentence ends, without punctuation and comment
marks. A template of n words matches where at least ``similar`` of them stand in order, so one of any
n - similar * n + 1 of its words must be there: the words that fewest templates have are its anchors.
Around each anchor in a text lies a window, a quarter of the template wider on either side. A window
holding enough of the template's words is compressed plainly and with the template as zstandard raw
dictionary; every template that saves size is confirmed by its exact wording differences. Where
findings overlap, the one with most equal less differing words is kept. Null, empty and licence-free
texts give an empty list.
"""

import difflib
import math
import re
from collections import Counter
from pathlib import Path

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and wordings of common licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {} of the License, or (at your option) any later version."
#: Further usual notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    *((name, FREE.format(*what)) for name, what in {
        "GPL-2.0": ("General Public License", "either version 2"), "GPL-3.0": ("General Public License", "either version 3"), "AGPL-3.0": ("Affero General Public License", "either version 3"),
        "LGPL-2.1": ("Lesser General Public License", "either version 2.1"), "LGPL-3.0": ("Lesser General Public License", "either version 3"),
    }.items()),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
]
#: All wordings as (name, text): the notices, and full licence texts by file name.
WORDINGS = [*TEMPLATES.items(), *NOTICES, *((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))]
WORD = re.compile(r"\w+")
#: Line ends with the comment marks after them.
BREAK = re.compile(r"\s*\n[\s/*#;%!>|-]*")


class Template:
    def __init__(self, name: str, text: str, similar: float):
        self.name, self.words = name, [w.lower() for w in WORD.findall(text)]
        self.bag = Counter(self.words)
        self.need = max(1, math.ceil(similar * len(self.words) - 1e-9))
        self.slack = max(4, len(self.words) // 4)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def anchors(self, spread: Counter) -> set[str]:
        """The least spread words, so many that a match cannot do without all of them."""
        out, left = set(), len(self.words) - self.need + 1
        for w in sorted(self.bag, key=lambda w: (spread[w], -len(w), w)):
            if left <= 0:
                break
            out.add(w)
            left -= self.bag[w]
        return out

    def enough(self, bag: Counter) -> bool:
        return sum(min(c, bag[w]) for w, c in self.bag.items()) >= self.need


class Scanner:
    def __init__(self, templates, similar: float):
        """``templates`` has names and wordings, as a mapping or, with several wordings of a name, as pairs."""
        pairs = templates.items() if isinstance(templates, dict) else templates
        self.templates = [t for t in (Template(k, v, similar) for k, v in pairs) if t.words]
        spread = Counter(w for t in self.templates for w in t.bag)
        self.anchors: dict[str, list[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t.anchors(spread):
                self.anchors.setdefault(w, []).append(i)
        self.plain = zstandard.ZstdCompressor(level=3)

    def saved(self, block: str, t: Template) -> int:
        data = BREAK.sub(" ", block).encode("utf-8", "replace")
        return len(self.plain.compress(data)) - len(t.press.compress(data))

    def confirm(self, t: Template, words: list[str]):
        """(equal less differing words, differing words, first and last place in ``words``, and where
        the template would begin), or None."""
        m = difflib.SequenceMatcher(None, t.words, words, autojunk=False)
        blocks = m.get_matching_blocks()[:-1]
        # A stray equal word far from the others is left out while enough is equal without it.
        while len(blocks) > 1 and sum(b.size for b in blocks) > t.need:
            ends = [(blocks[1].b - blocks[0].b - blocks[0].size, 0), (blocks[-1].b - blocks[-2].b - blocks[-2].size, -1)]
            gap, end = max(ends)
            if gap <= 2 * blocks[end].size or sum(b.size for b in blocks) - blocks[end].size < t.need:
                break
            del blocks[end]
        same = sum(b.size for b in blocks)
        if same < t.need:
            return None
        differ = blocks[0].a + len(t.words) - blocks[-1].a - blocks[-1].size
        for x, y in zip(blocks, blocks[1:]):
            differ += max(y.a - x.a - x.size, y.b - x.b - x.size)
        return same - differ, differ, blocks[0].b, blocks[-1].b + blocks[-1].size - 1, blocks[0].b - blocks[0].a

    def find(self, text: str | None):
        """Findings of a text in order: (start, end, licence, size saved, differing words)."""
        words = [w.lower() for w in WORD.findall(text or "")]
        if self.anchors.keys().isdisjoint(words):
            return []
        hits: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for i in self.anchors.get(w, ()):
                hits.setdefault(i, []).append(at)
        bag, spans, found = Counter(words), [m.span() for m in WORD.finditer(text)], []
        for i, places in hits.items():
            t = self.templates[i]
            if not t.enough(bag):
                continue
            n, where, done, tried = len(t.words), {}, -1, set()
            for j, w in enumerate(t.words):
                where.setdefault(w, []).append(j)
            for at in places:
                if at <= done:
                    continue
                for j in where[words[at]]:
                    # Starts of one half slack share a window, which is wide enough for both.
                    low = (at - j) // max(1, t.slack // 2) * max(1, t.slack // 2)
                    if low in tried or at <= done:
                        continue
                    tried.add(low)
                    a, b = max(0, low - t.slack, done + 1), min(len(words), low + n + 2 * t.slack)
                    if not t.enough(Counter(words[a:b])) or not (got := self.confirm(t, words[a:b])):
                        continue
                    # An anchor may be one of several like words; the window is laid anew from the match.
                    again = max(0, a + got[4] - t.slack, done + 1)
                    more = self.confirm(t, words[again : a + got[4] + n + t.slack])
                    if more and more[0] > got[0]:
                        a, got = again, more
                    score, differ, x, y, _ = got
                    start, end = spans[a + x][0], spans[a + y][1]
                    while end < len(text) and not text[end].isspace() and not text[end].isalnum():
                        end += 1
                    if (gain := self.saved(text[start:end], t)) > 0:
                        found.append((score, gain, start, end, t.name, differ))
                        done = a + y
        kept = []
        for _, gain, start, end, name, differ in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            if all(end <= k[0] or start >= k[1] for k in kept):
                kept.append((start, end, name, gain, differ))
        return sorted(kept)

    def scan(self, block: str):
        """(licence, size saved, differing words) of the best finding, or None."""
        found = self.find(block)
        return min((f[2:] for f in found), key=lambda f: (f[2], -f[1])) if found else None


def scan(docs: DataFrame, templates=WORDINGS, similar: float = 0.8) -> DataFrame:
    """doc_id and its findings: (start, end, license, saved, differing)."""

    @F.pandas_udf("array<struct<start:int,end:int,license:string,saved:int,differing:int>>")
    def every(text: pd.Series) -> pd.Series:
        s = Scanner(templates, similar)
        names = ("start", "end", "license", "saved", "differing")
        out = [[dict(zip(names, f)) for f in s.find(t)] for t in text]
        return pd.Series(out, dtype="object")

    return docs.select("doc_id", every("text").alias("found"))


def digest(found: DataFrame) -> DataFrame:
    one = F.transform("found", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), s["differing"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda s: s["license"])))).alias("licenses"), F.concat_ws(",", one).alias("spans"))
