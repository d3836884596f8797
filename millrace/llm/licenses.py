"""Licence scan with DataFrame functions only: MinHash bands over text windows, then exact containment.

A document holds a licence if it contains min_containment (0.8) or more of the distinct five-word
shingles of its template. Words are cut at ASCII white space, lower-cased, and stripped of what is no
a-z or 0-9 at their ends.

Retrieval: a template with n shingles is retrieved by windows of w shingles, the largest of SIZES up to
the number that a text must hold of it. Template windows start at every shingle, document windows at every w/4-th. If a document holds 0.8
of a template, some window of it holds 0.8 of the aligned one, a Jaccard similarity of 2/3 or more, so
BANDS = 12 bands of 2 minima miss with a probability under (1 - 4/9)**12, 0.09 %, for a single pair of
windows. Templates of under four shingles must be there whole, so one band finds them for certain.

Pruning without loss: by rule, each template has anchor words such that its shingles without any of
them are under min_containment; a text that contains no anchor as a substring can't match, and is left
after one pass over its characters.

At scale: only matching texts' words go on, once, into the shared folder; templates are parameters, so
their bands, which are broadcast, are of a fixed size. No shuffle is keyed by anything but a row number.

Defined results: a null, empty or short text matches nothing. Each repeated row has matches of its own.
A text that holds several licences has a row for each. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 5
SIZES = (1, 2, 3, 4, 8, 16, 32)
BANDS, MINIMA = 12, 2

# Names and notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class LicensePolicy:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    min_containment: float = 0.8


def normal_words(text: str) -> list[str]:
    """As word_array(), for templates."""
    return [w for w in (re.sub("^[^a-z0-9]+|[^a-z0-9]+$", "", w) for w in re.split("[\x20\x09-\x0d]+", text.lower())) if w]


def word_array(text: Column) -> Column:
    words = F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", "")), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: as a lambda's variable, not as an expression in each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_array(words: Column) -> Column:
    """The shingles in order, repeats included; none for fewer words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(1)))
        return F.when(F.size(w) >= WIDTH, F.transform(starts, lambda i: F.array_join(F.slice(w, i, WIDTH), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, cut)


def anchors(policy: LicensePolicy) -> list[str]:
    """Words such that a text with none of them can't reach min_containment of any template. Longer words, which are rarer, come first."""
    chosen: set[str] = set()
    for _, text in policy.templates:
        words = normal_words(text)
        shingles = [words[i : i + WIDTH] for i in range(len(words) - WIDTH + 1)]
        while True:
            bare = [s for s in shingles if not any(a in w for w in s for a in chosen)]
            if len({tuple(s) for s in bare}) < policy.min_containment * len({tuple(s) for s in shingles}) or not bare:
                break
            n = Counter(w for s in bare for w in set(s))
            chosen.add(max(n, key=lambda w: (min(len(w), 8), n[w], w)))
    return sorted(a for a in chosen if not any(b != a and b in a for b in chosen))


def window_size(n: int, min_containment: float = 0.8) -> int:
    """Of a template of n shingles: no larger than what a text must hold of it, so every text that can match has a window."""
    return max(s for s in SIZES if s <= max(1, ceil(min_containment * n - 1e-9)))


def band_keys(shingles: Column, size: int, step: int) -> Column:
    """Keys of the bands of all windows of so many shingles; the last window ends with the text."""
    n_bands = BANDS if size >= 4 else 1
    seeds = F.sequence(F.lit(0), F.lit(n_bands * MINIMA - 1))

    def keys(window: Column) -> Column:
        minima = F.transform(seeds, lambda j: F.array_min(F.transform(window, lambda h: F.xxhash64(h, j))))
        return let(minima, lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.xxhash64(F.lit(size), b, *(F.get(m, b * MINIMA + k) for k in range(MINIMA)))))

    def windows(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - size + 1, F.lit(1))
        starts = F.array_union(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))
        return F.when(F.size(hashes) >= size, F.transform(starts, lambda i: F.slice(hashes, i, size))).otherwise(F.array().cast("array<array<bigint>>"))

    return let(F.transform(shingles, lambda s: F.xxhash64(s)), lambda h: F.flatten(F.transform(windows(h), keys)))


def find_licenses(df: DataFrame, policy: LicensePolicy = LicensePolicy(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, containment, n_matched, n_shingles, first_word and end_word (of the shingles matched, in words as above, end exclusive)."""
    spark = df.sparkSession
    counts = {name: len(normal_words(t)) - WIDTH + 1 for name, t in policy.templates}
    if min(counts.values()) < 1:
        raise ValueError("a template has fewer than five words")
    fit = {name: window_size(n, policy.min_containment) for name, n in counts.items()}
    sizes = sorted(set(fit.values()))
    table = spark.createDataFrame(list(policy.templates), "license string, notice string").select("license", shingle_array(word_array(F.col("notice"))).alias("t"))
    by_size = [table.where(F.col("license").isin([k for k, n in fit.items() if n == s])).select("license", F.explode(band_keys(F.col("t"), s, 1)).alias("key")) for s in sizes]
    bands = reduce(DataFrame.unionByName, by_size).distinct()
    low = F.lower(F.col(f"`{text}`"))
    anchored = reduce(Column.__or__, (F.contains(low, F.lit(a)) for a in anchors(policy)))
    words = df.where(anchored).select(F.col(f"`{doc_id}`").alias("doc_id"), word_array(F.col(f"`{text}`")).alias("words"), F.monotonically_increasing_id().alias("row"))
    words = materialize(words)
    shingles = words.select("row", shingle_array(F.col("words")).alias("s"))
    keys = let(F.col("s"), lambda v: F.array_distinct(F.concat(*(band_keys(v, s, max(1, s // 4)) for s in sizes))))
    found = shingles.select("row", F.explode(keys).alias("key")).join(F.broadcast(bands), "key").select("row", "license").distinct()
    pairs = found.join(words, "row").join(F.broadcast(table), "license")

    def match(s: Column, t: Column) -> Column:
        hit = F.filter(F.transform(s, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
        return F.struct(F.size(F.array_intersect(s, t)).cast("long").alias("n"), F.size(t).cast("long").alias("of"), F.array_min(hit).cast("long").alias("a"), (F.array_max(hit) + WIDTH).cast("long").alias("b"))

    # Checked in its own projection; the filter below reads its fields.
    both = F.struct(shingle_array(F.col("words")).alias("s"), F.array_distinct("t").alias("t"))
    checked = pairs.select("doc_id", "license", F.explode(F.transform(F.array(both), lambda v: match(v["s"], v["t"]))).alias("m"))
    out = checked.select("doc_id", "license", (F.col("m.n") / F.col("m.of")).alias("containment"), F.col("m.n").alias("n_matched"), F.col("m.of").alias("n_shingles"), F.col("m.a").alias("first_word"), F.col("m.b").alias("end_word"))
    return out.where(F.col("containment") >= policy.min_containment)
