"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

A template is a license notice. Texts and templates become words (lower case; letters and digits)
and five-word shingles, hashed. Windows of a few sizes slide over the shingles of a text, each half
overlapping the next; a window's band is the least value of one hash permutation over it. Templates
are indexed at every offset with the window size that suits their length. A window inside a copy of
a template equals a window of the template, so all its bands collide: the probability is 1. After
edits, two windows of w shingles that share a fraction s of them have the Jaccard similarity
j = s / (2 - s) and collide in one of BANDS one-row bands with probability 1 - (1 - j) ** BANDS:
0.988 for s of 0.8. A text that contains CONTAINED of a template's shingles has several windows, each
of which may retrieve it, so it is missed more rarely; the tests measure the recall on edited copies.

Each (template, place) that a band retrieves is verified exactly: the share of the template's
different shingles, compared as hashes of all five words, that occur in the text around the window
(as long as the template, on both sides) must be CONTAINED or more.

The whole scan is DataFrame expressions within a row: nothing is shuffled. The templates are a
parameter, refused beyond MAX_SHINGLES, so the tables that travel with the plan are bounded.

Defined results: a null or empty text has no licenses. A template with fewer than five words is
one shingle of all its words and is looked for as such. Repeated rows get equal results. Only the
text is read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, BANDS = 5, 0.8, 4
#: Window sizes in shingles; a template uses the largest of which two fit into it.
WINDOWS = (1, 4, 16)
MAX_SHINGLES = 100_000
#: Keys of the hash permutations.
KEYS = (-7046029254386353131, 7664345821815920749, -4417276706812531889, 1609587929392839161)

#: Notices of common licenses, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    """Words of a text: runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of the five-word shingles of an array of words; one of all words if there are fewer."""
    size = F.size(w)

    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])

    whole = F.when(size > 0, F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))
    return F.when(size >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0))), at)).otherwise(whole)


def band(s: Column, start: Column, window: int, k: int) -> Column:
    """Band k of the window of shingles that starts (from 0) at start."""
    return F.array_min(F.transform(F.slice(s, start + 1, F.lit(window)), lambda h: mixed(h, k)))


def mixed(h: Column, k: int) -> Column:
    """One permutation of the hashes: xor with its shifted self (which can be undone), then with a key."""
    return h.bitwiseXOR(F.shiftrightunsigned(h, 29 + k)).bitwiseXOR(F.lit(KEYS[k]))


class Templates:
    """The index of the templates: shingles of each, and template numbers by window size, band and value."""

    def __init__(self, spark, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(templates)], "k int, text string")
        rows = rows.select("k", shingles(words(F.col("text"))).alias("s"))
        self.shingles = [list(dict.fromkeys(r.s)) for r in rows.orderBy("k").collect()]
        if sum(map(len, self.shingles)) > MAX_SHINGLES:
            raise ValueError(f"the templates have more than {MAX_SHINGLES} shingles")
        self.window = [max([w for w in WINDOWS if 2 * w <= len(s)], default=1) for s in self.shingles]
        self.bands: dict[int, dict[int, dict[int, set[int]]]] = {w: {k: {} for k in range(BANDS if w > 1 else 1)} for w in WINDOWS}
        for w in WINDOWS:
            mine = [(k, s) for k, s in enumerate(self.shingles) if self.window[k] == w and s]
            if not mine:
                continue
            found = spark.createDataFrame(mine, "k int, s array<bigint>").select(
                "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - w), lambda i: F.array(*[band(F.col("s"), i, w, b) for b in self.bands[w]]))).alias("v")
            )
            for r in found.collect():
                for b, v in enumerate(r.v):
                    self.bands[w][b].setdefault(v, set()).add(r.k)


def hits(s: Column, w: int, b: int, table: dict[int, set[int]]) -> Column:
    """Array of (k, at): templates that band b of the windows of size w retrieves, and the window's start."""
    if w == 1:
        values = F.transform(s, lambda h, i: F.struct(mixed(h, b).alias("v"), i.alias("at")))
    else:
        starts = F.when(F.size(s) >= w, F.sequence(F.lit(0), F.greatest(F.size(s) - w, F.lit(0)), F.lit(w // 2))).otherwise(F.array().cast("array<int>"))
        values = F.transform(starts, lambda i: F.struct(band(s, i, w, b).alias("v"), i.alias("at")))
    known = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, ks in sorted(table.items()) for k in sorted(ks)])
    found = F.filter(values, lambda x: x["v"].isin(list(table)))
    return F.flatten(F.transform(found, lambda x: F.transform(F.filter(known, lambda y: y["v"] == x["v"]), lambda y: F.struct(y["k"].alias("k"), x["at"].alias("at")))))


def retrieved(s: Column, index: Templates) -> Column:
    """What all bands of all window sizes retrieve."""
    out = [hits(s, w, b, table) for w, bands in index.bands.items() for b, table in bands.items() if table]
    return F.array_distinct(F.concat(*out)) if out else F.array().cast("array<struct<k:int,at:int>>")


def apply(docs: DataFrame, keep: list[str], index: Templates | None = None) -> DataFrame:
    """The columns named in keep, n_licenses, licenses (sorted, comma-joined) and matches
    (template:first shingle of the retrieving window:contained shingles) of every row."""
    index = index or Templates(docs.sparkSession)
    size = F.array(*[F.lit(len(s)) for s in index.shingles])
    all_shingles = F.array(*[F.array(*[F.lit(h) for h in s]).cast("array<bigint>") for s in index.shingles])
    names = F.array(*[F.lit(n) for n in index.names])
    rows = docs.select(*keep, words(F.col("text")).alias("__w")).select(*keep, shingles(F.col("__w")).alias("__s"))
    # a text without any shingle of a template contains none, whatever its bands: windows aren't cut there
    known = sorted({h for s in index.shingles for h in s})
    able = F.exists("__s", lambda h: h.isin(known)) if known else F.lit(False)
    nothing = F.array().cast("array<struct<k:int,at:int>>")
    rows = rows.select(*keep, "__s", F.when(able, retrieved(F.col("__s"), index)).otherwise(nothing).alias("__c"))

    def check(x: Column) -> Column:
        n = F.get(size, x["k"])
        start = F.greatest(x["at"] - n, F.lit(0))
        around = F.slice(F.col("__s"), start + 1, 2 * n + x["at"] - start)
        return F.struct(x["k"].alias("k"), x["at"].alias("at"), F.size(F.array_intersect(F.get(all_shingles, x["k"]), around)).alias("n"))

    found = F.filter(F.transform("__c", check), lambda x: x["n"] >= CONTAINED * F.get(size, x["k"]))
    rows = rows.select(*keep, F.sort_array(found).alias("__f"))
    licenses = F.array_sort(F.array_distinct(F.transform("__f", lambda x: F.get(names, x["k"]))))
    # of the windows that retrieve one template, the first
    firsts = F.filter("__f", lambda x, i: (i == 0) | (F.get("__f", i - 1)["k"] != x["k"]))
    listed = F.array_join(F.transform(firsts, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["at"], x["n"])), ",")
    return rows.select(*keep, F.size(licenses).cast("long").alias("n_licenses"), F.array_join(licenses, ",").alias("licenses"), listed.alias("matches"))
