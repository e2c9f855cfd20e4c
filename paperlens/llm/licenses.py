"""License scans: MinHash of overlapping text windows retrieves templates, containment verifies them.

Words are runs of a-z and 0-9 of the lowered text, shingles five words (a text of fewer is one
shingle). A template of n shingles is looked for in windows of ``SPAN`` n shingles that begin every n, so a copy
lies whole in some window if it spans no more than ``SPAN`` - 1 times its length, whatever has been put in between and
wherever it stands. A copy with ``CONTAINMENT`` of the shingles has a Jaccard similarity of at least
0.8 / 4.2 = 0.19 to that window; with ``HASHES`` bands of one row they collide with probability
1 - 0.81 ** 32 = 0.999. A band can only collide if the window holds the shingle that is the template's
minimum, so documents without any such shingle are passed over at once, which changes no result.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlens.operators.frames import computed_once

SHINGLE, HASHES, CONTAINMENT = 5, 32, 0.8
# Length of a window in lengths of the template.
SPAN = 4
# Templates are compared inside each task, so they are few.
MAX_TEMPLATES = 200

# Wordings of license notices and of short licenses, without names of owners.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
     "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, in order; null: none."""
    def hashed(words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)),
            lambda at: F.xxhash64(*[F.element_at(words, at + i) for i in range(SHINGLE)]),
        )
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(
            F.array().cast("array<bigint>"))
        return F.when(F.size(words) >= SHINGLE, runs).otherwise(short)

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    # A lambda over one element, so that the words are formed once.
    return F.flatten(F.transform(F.array(words), hashed))


def _minimum(window: Column, number: Column) -> Column:
    return F.array_min(F.transform(window, lambda s: F.xxhash64(s, number)))


def _prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> list[dict]:
    """Per template its name, distinct shingles, MinHash values and the shingles that have them."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    if not templates:
        return []
    rows = F.explode(F.array(*[
        F.struct(F.lit(at).alias("at"), F.lit(text).alias("text")) for at, (_, text) in enumerate(templates)]))
    numbers = F.array(*[F.lit(i) for i in range(HASHES)])
    found = (
        spark.range(1).select(rows.alias("t"))
        .select("t.at", F.array_distinct(shingles(F.col("t.text"))).alias("shingles"))
        .where(F.size("shingles") > 0)
        .withColumn("minima", F.transform(numbers, lambda i: _minimum(F.col("shingles"), i)))
        .withColumn("signs", F.array_distinct(F.flatten(F.transform(numbers, lambda i: F.filter(
            "shingles", lambda s: F.xxhash64(s, i) == F.get(F.col("minima"), i))))))
    )
    return [{"name": templates[r["at"]][0], **r.asDict()} for r in found.orderBy("at").collect()]


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scan(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` without ``text``, with ``licenses``: array of (license, start, end, containment).

    start and end are positions in the words of the text: from the first to the last shingle of the
    template in a window that has at least ``CONTAINMENT`` of its different shingles; ordered by license and
    start, without spans inside wider ones of the same license. Null and empty texts have an empty array. A very
    long text is held as its shingles, and of its windows only those that hold a sign of a template are compared.
    Rows are kept one by one; a column named licenses is replaced.
    """
    prepared = _prepared(docs.sparkSession, templates)
    kept = [f"`{c}`" for c in docs.columns if c not in (text, "licenses")]
    empty = F.array().cast("array<struct<license:string,start:int,end:int,containment:double>>")
    if not prepared:
        return docs.select(*kept, empty.alias("licenses"))
    known = F.array(*[
        F.struct(F.lit(t["name"]).alias("name"), _longs(t["shingles"]).alias("shingles"),
                 _longs(t["minima"]).alias("minima"), _longs(t["signs"]).alias("signs")) for t in prepared
    ])
    signs = _longs(sorted({s for t in prepared for s in t["signs"]}))
    numbers = F.array(*[F.lit(i) for i in range(HASHES)])
    own = F.col("_shingles")

    def collides(window: Column, template: Column) -> Column:
        return F.exists(numbers, lambda i: _minimum(window, i) == F.get(template["minima"], i))

    def windows(template: Column) -> Column:
        size = F.size(template["shingles"])
        cut = F.transform(
            F.sequence(F.lit(0), F.size(own) - 1, size),
            lambda start: F.struct(start.alias("start"), F.slice(own, start + 1, size * SPAN).alias("part")),
        )
        # The template's minima can only be met where its signs are.
        met = F.filter(cut, lambda w: F.arrays_overlap(w["part"], template["signs"]))
        met = F.filter(met, lambda w: collides(w["part"], template))
        counted = F.transform(met, lambda w: F.struct(
            w["start"].alias("start"),
            F.size(F.array_intersect(w["part"], template["shingles"])).alias("shared"),
            F.filter(F.transform(w["part"], lambda s, at: F.when(F.array_contains(template["shingles"], s), at)),
                     lambda at: at.isNotNull()).alias("places"),
        ))
        enough = F.filter(counted, lambda w: w["shared"] >= F.lit(CONTAINMENT) * size)
        return F.transform(enough, lambda w: F.struct(
            template["name"].alias("license"),
            (w["start"] + F.array_min(w["places"])).alias("start"),
            (w["start"] + F.array_max(w["places"]) + SHINGLE).alias("end"),
            (w["shared"] / size).alias("containment"),
        ))

    matches = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter(known, lambda t: F.arrays_overlap(own, t["signs"])), windows))))

    def widest(found: Column) -> Column:
        """Without spans inside a wider span of the same license."""
        return F.filter(found, lambda m: ~F.exists(found, lambda other: (
            (other["license"] == m["license"]) & (other["start"] <= m["start"]) & (other["end"] >= m["end"])
            & (other["end"] - other["start"] > m["end"] - m["start"]))))

    all_matches = F.flatten(F.transform(F.array(matches), widest))
    return (
        docs.select(*kept, computed_once(shingles(F.col(f"`{text}`"))).alias("_shingles"))
        .select(*kept, F.when(F.arrays_overlap(own, signs), all_matches).otherwise(empty).alias("licenses"))
    )
