"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar.llm.shared import bind, stored, text_of

SHINGLE_WORDS, CONTAINMENT = 3, 0.8
WINDOWS = (4, 8, 16, 32)  # words; windows follow each other by half their length
BANDS = 24
MOST_TEMPLATE_WORDS = 200_000  # of all templates; what goes to every task grows with them alone

# Notices as they stand in files of these licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
    "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the three-word runs in order; words are letters and digits in lower case. Fewer than three words: none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")

    def runs(w: Column) -> Column:
        last = F.size(w) - SHINGLE_WORDS
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return bind(words, runs)


def _bands(window: Column, scale: Column) -> Column:
    """Keys of the bands of a window: a band is one MinHash value, the smallest after hashing with the band's own number."""
    keys = []
    for band in range(BANDS):
        least = F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(band))))
        keys.append(F.xxhash64(F.lit(band), scale, least))
    return F.array(*keys)


def _template_windows(templates: DataFrame) -> DataFrame:
    """Rows (template, offset, scale, key) of the pieces under which templates are found.

    A piece of up to half a window and one word lies within one of the windows whole. A template takes the smallest window that has
    room for it so; a longer one is cut into pieces that overlap by half.
    """
    size = F.size("hashes")
    scale = F.lit(WINDOWS[-1])
    for w in reversed(WINDOWS[:-1]):
        scale = F.when(size + SHINGLE_WORDS - 1 <= w // 2 + 1, w).otherwise(scale)
    piece = WINDOWS[-1] // 2 + 1 - SHINGLE_WORDS + 1
    last = F.greatest(size - piece, F.lit(0))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(piece // 2)), F.array(last)))
    cut = templates.withColumn("scale", scale).withColumn("offset", F.explode(offsets))
    cut = cut.withColumn("window", F.slice("hashes", F.col("offset") + 1, F.lit(piece)))
    return cut.select("template", "offset", "scale", F.explode(_bands(F.col("window"), F.col("scale"))).alias("key")).distinct()


def find_licenses(documents: DataFrame, templates: DataFrame, key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """Matches: (doc, row, template, containment, start), one row per document and template; start counts words from 0.

    A window that shares no shingle with any template can have no band in common with one, so only windows with such a
    shingle are hashed. 24 bands of one value find a verbatim template (at least 4/15 of its window's shingles) with 99.9 %, and one
    with a fifth of its shingles lost with 99 %. Around a window that found a template, the share of the template's shingles decides.
    """
    listed = templates.select(F.col("template"), F.array_distinct(shingle_hashes(text_of("text"))).alias("hashes")).filter("template IS NOT NULL")
    listed = stored(listed.filter(F.size("hashes") > 0), "templates")
    words = listed.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    if words > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {words} words; at most {MOST_TEMPLATE_WORDS} go to every task")
    known = sorted(r["h"] for r in listed.select(F.explode("hashes").alias("h")).distinct().collect())  # bounded by the check above
    any_known = F.array(*[F.lit(h) for h in known]).cast("array<bigint>") if known else F.array().cast("array<bigint>")
    text = text_of("text")
    hashed = documents.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), text).alias("row"), shingle_hashes(text).alias("hashes"))
    hashed = stored(hashed.filter(F.arrays_overlap("hashes", any_known)), "license-documents").distinct()
    spaces = F.array(*[F.struct(F.lit(w).alias("scale"), F.lit(w // 2).alias("step"), F.lit(w - SHINGLE_WORDS + 1).alias("length")) for w in WINDOWS])
    windows = hashed.select("doc", "row", "hashes", F.inline(spaces))
    windows = windows.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1, F.col("step"))))
    windows = windows.select("doc", "row", "scale", "start", F.slice("hashes", F.col("start") + 1, F.col("length")).alias("window"))
    windows = windows.filter(F.arrays_overlap("window", any_known))
    banded = windows.select("doc", "row", "scale", "start", F.explode(_bands(F.col("window"), F.col("scale"))).alias("key"))
    found = banded.join(_template_windows(listed).select("template", "offset", "key"), "key")
    found = found.select("doc", "row", "template", (F.col("start") - F.col("offset")).alias("from"), "scale").distinct()
    own = hashed.select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "hashes")
    near = found.join(own, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")))
    near = near.join(listed.select("template", F.col("hashes").alias("wanted")), "template")
    low = F.greatest(F.col("from") - F.col("scale"), F.lit(0))
    around = F.slice("hashes", low + 1, F.size("wanted") + 3 * F.col("scale"))
    near = near.withColumn("around", around).withColumn("shared", F.array_intersect("wanted", "around"))
    near = near.withColumn("containment", F.size("shared") / F.size("wanted")).filter(F.col("containment") >= containment)
    place = low + F.array_min(F.transform("shared", lambda h: F.array_position("around", h))).cast("int") - 1
    best = F.max_by(F.struct("containment", place.alias("start")), F.struct("containment", -place))
    best = near.groupBy("doc", "row", "template").agg(best.alias("best"))
    return best.select("doc", "row", "template", "best.containment", "best.start")


def scan(
    documents: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", containment: float = CONTAINMENT
) -> DataFrame:
    """Every row of `documents` with what was found: key, n_licenses, licenses (template, containment, start by template).

    Null and empty texts, texts of fewer than three words and an empty table of templates match nothing; templates of fewer
    than three words are never found; templates of one name count as one of its texts each. Rows that repeat key and text
    have equal results.
    """
    spark = documents.sparkSession
    found = find_licenses(documents, default_templates(spark) if templates is None else templates, key, containment)
    listed = found.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("template", "containment", "start"))).alias("licenses"))
    listed = stored(listed, "licenses").select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "licenses")
    rows = documents.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), text_of("text")).alias("row"))
    joined = rows.join(listed, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    none = F.array().cast("array<struct<template:string,containment:double,start:int>>")
    licenses = F.coalesce("licenses", none)
    return joined.select(F.col("doc").alias(key), F.size(licenses).alias("n_licenses"), licenses.alias("licenses"))
