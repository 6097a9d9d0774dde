"""License scans: MinHash bands over overlapping windows of the text retrieve templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are five words. Templates of similar length share a scale:
the power of two `s` of at least their shingles. Windows have 2s shingles of the text at a stride of s, so a template of
up to s shingles lies whole in one of them. With a containment of 0.8 or more the window's similarity to the template is
0.19 or more, and with 64 bands of one minimum each, none agrees with a probability below 2e-6.

A band's key is the window's shingle of the least hash, so a window can agree with a template in a band only if it holds
the shingle that is the template's own key there. Texts and windows that hold no such shingle are left out before
anything is sketched: they cannot be retrieved. Before that, texts that hold none of a few words of the templates are
left out unsplit: each of them lacks more of every template than the containment allows. All shingles of the windows
left are sketched, the sketches are joined with the templates' by band, and only what that retrieves is verified: the
share of the template's shingles that the window holds.

Texts are read in one pass without a shuffle; what follows works on the texts that hold a template's key.

Defined cases: null and empty texts and texts below five words match nothing and give no rows; a license found in
several windows is one row with its best window (the first of equals); rows are scanned one by one, whether they share
an id or have none; an empty table gives no rows; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import local_table, stage

K, BANDS = 5, 64
#: Words of at least so many letters are preferred as marks.
MARK_CHARS = 7

# The notices that are looked for (public license texts), by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def template_shingles(templates: dict[str, str], k: int = K) -> list[tuple[str, str, int, int]]:
    """(license, shingle, its distinct shingles, scale) of every template of at least k words."""
    out = []
    for name, text in sorted(templates.items()):
        words = re.findall(r"[^\W_]+", text.lower())
        found = sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        places = max(len(words) - k + 1, 1)
        out += [(name, s, len(found), 1 << (places - 1).bit_length()) for s in found]
    return out


def marks(shingles: list[tuple[str, str, int, int]], containment: float) -> list[str]:
    """A few words, one of which a text holds (inside a word or as one) if it contains so much of some template.

    Such a text lacks few of the template's shingles, so one of any larger number of them is there. Time after time the
    word is taken that is in most of the shingles still wanted; longer words first, since short ones are everywhere.
    """
    left: dict[str, set[str]] = {}
    for name, s, _, _ in shingles:
        left.setdefault(name, set()).add(s)
    need = {}
    for name, own in left.items():
        m = len(own)
        need[name] = min(m, m - next((h for h in range(m) if h / m >= containment), m) + 1)
    out = []
    while left:
        words = {w for own in left.values() for s in own for w in s.split(" ")}
        count = {w: sum(min(need[name], sum(w in s for s in own)) for name, own in left.items()) for w in words}
        mark = max(words, key=lambda w: (len(w) >= MARK_CHARS, count[w], w))
        out.append(mark)
        for name, own in list(left.items()):
            left[name] = {s for s in own if mark not in s}
            need[name] -= len(own) - len(left[name])
            if need[name] <= 0:
                del left[name]
    return out


def _marked(docs: DataFrame, words: list[str], text: str) -> DataFrame:
    """Those of docs whose text, in lower case, holds one of the words."""
    # an array of one, so that the text is lower-cased once
    return docs.where(F.exists(F.array(F.lower(F.col(text))), lambda t: reduce(or_, (F.contains(t, F.lit(w)) for w in words), F.lit(False))))


def _template_table(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    rows = local_table(spark, template_shingles(templates, k), "license string, words string, m int, scale int")
    return rows.select("license", F.xxhash64("words").alias("shingle"), "m", "scale")


def _hash(band: int, shingle: Column) -> Column:
    return F.xxhash64(F.lit(band), shingle)


def sketched(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, band, minimum: for rows (keys, shingle) the least hash of each group's shingles in every band."""
    minima = rows.groupBy(*keys).agg(*(F.min(_hash(b, F.col("shingle"))).alias(f"m{b}") for b in range(BANDS)))
    return minima.select(*keys, F.posexplode(F.array(*(f"m{b}" for b in range(BANDS)))).alias("band", "minimum"))


def anchors(known: DataFrame) -> DataFrame:
    """scale, keys: the shingles that are a band's key of some template (BANDS a template at most)."""
    hashed = known.select("license", "scale", "shingle", F.posexplode(F.array(*(_hash(b, F.col("shingle")) for b in range(BANDS)))).alias("band", "h"))
    least = hashed.groupBy("license", "scale", "band").agg(F.min_by("shingle", "h").alias("shingle"))
    return least.groupBy("scale").agg(F.collect_set("shingle").alias("keys"))


def shingled(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """doc_id and shingles (hashes in order; none below k words)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, k), " ")))
    return docs.select("doc_id", words.alias("words")).select("doc_id", F.when(n >= k, hashes).alias("shingles"))


def windows(docs: DataFrame, known: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """row (a number), doc_id, scale, window (from 0), held (its shingles): those that hold a template's key."""
    keys = anchors(known)
    # one row, and one per scale; both hold BANDS shingles a template at most
    every = keys.agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("every"))
    some = shingled(docs, text, k).crossJoin(F.broadcast(every)).where(F.arrays_overlap("shingles", "every"))
    some = stage(some.select("doc_id", F.monotonically_increasing_id().alias("row"), "shingles"), "licensed")
    number = F.explode(F.sequence(F.lit(0), F.floor((F.size("shingles") - 1) / F.col("scale")).cast("int")))
    cut = some.crossJoin(F.broadcast(keys)).withColumn("window", number)
    cut = cut.withColumn("held", F.slice("shingles", F.col("window") * F.col("scale") + 1, 2 * F.col("scale")))
    return cut.where(F.arrays_overlap("held", "keys")).select("row", "doc_id", "scale", "window", "held")


def licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """doc_id, license, containment, at (the first matching word's number): a row for each license found in a row of docs."""
    templates = templates or TEMPLATES
    known = _template_table(docs.sparkSession, templates, K)
    some = _marked(docs, marks(template_shingles(templates, K), containment), text)
    cut = stage(windows(some, known, text), "windows")

    own = sketched(cut.select("row", "scale", "window", F.explode("held").alias("shingle")), "row", "scale", "window")
    theirs = F.broadcast(sketched(known, "license", "scale"))  # BANDS rows a template
    candidates = own.join(theirs, ["scale", "band", "minimum"]).select("row", "scale", "window", "license").distinct()

    whole = known.groupBy("license", "m").agg(F.collect_list("shingle").alias("template"))
    found = candidates.join(cut, ["row", "scale", "window"]).join(F.broadcast(whole), "license")
    found = found.withColumn("shared", F.array_intersect("held", "template")).withColumn("containment", F.size("shared") / F.col("m")).where(F.col("containment") >= containment)
    at = F.col("window") * F.col("scale") + F.array_min(F.transform("shared", lambda x: F.array_position("held", x))) - 1
    best = found.groupBy("row", "doc_id", "license").agg(F.max(F.struct("containment", (-F.col("window")).alias("w"), at.cast("long").alias("at"))).alias("best"))
    return best.select("doc_id", "license", "best.containment", "best.at")
