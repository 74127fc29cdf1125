"""Operator 10, license scans (DataFrame operations only).

Texts become lower-case words of ``[a-z0-9]``.  Words are looked at in overlapping windows
of W shingles (five words; a shorter template is one shingle), W/2 apart, with W at least
twice a template's length, so a template lies inside some window whole.  Each window has
one minimum hash per band; a band that agrees with a template's retrieves it, and the exact
share of the template's shingles inside the window must reach ``CONTAINMENT``.

The number of bands of a width follows from the smallest Jaccard similarity J that such a
window and template can have: ``(1 - J) ** bands <= MISS``.  Windows without any anchor
word are passed over: each template shingle holds at least one anchor, so they can't match.
Texts that hold one are written once, for all widths.

Templates are a short parameter list; their band table (a few thousand rows at most, the
bound is checked) is broadcast, texts are never shuffled; the rows that match are grouped.

Defined results: null, empty and short texts match nothing; repeated rows give repeated
matches; very long texts are looked at whole; of equally good windows the first counts; an empty table or no
templates give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SHINGLE = 5
CONTAINMENT = 0.75
MISS = 1e-6
MAX_TEMPLATES = 2000

#: notices and headers of public licences (fixed values); a text may match several of one family.  Parts of notices
#: whose shingles have no longer word (``use this file``) are left out, as their anchors would be on every page
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-warranty": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))))


def width(text: str) -> int:
    """Window width, in shingles, for a template."""
    return 2 * 2 ** math.ceil(math.log2(max(1, len(template_words(text)) - SHINGLE + 1)))


def bands(w: int) -> int:
    """Bands that find a template of this width's class with probability ``1 - MISS``."""
    m = w // 4 + 1 if w > 2 else 1
    j = CONTAINMENT * m / (w + (1 - CONTAINMENT) * m)
    return math.ceil(math.log(MISS) / math.log(1 - j))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which each template shingle holds one: its longest (first of equals)."""
    return sorted({max(s.split(" "), key=len) for t in templates.values() for s in template_shingles(t)})


def _hashes(words, count):
    """Hashes of the ``count`` shingles of an array of words."""
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def _minima(hashes, count: int):
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _windows(places, w: int):
    """Numbers of the windows of width ``w`` that hold one of the word places."""
    step = w // 2
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - (w + SHINGLE - 2)) / step)).cast("int")
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(first(i), F.floor(i / step).cast("int")))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment and first_word (start of the first matching window)."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates, so that their bands can be broadcast")
    spark = docs.sparkSession
    if not templates:
        return docs.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"))
    known = spark.createDataFrame([(n, width(t), template_words(t)) for n, t in templates.items()], "license string, width int, words array<string>")
    known = known.withColumn("known", F.array_distinct(_hashes("words", F.greatest(F.lit(1), F.size("words") - SHINGLE + 1))))
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    rare = anchors(templates)
    rows = (docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
            .where(F.lower("text").rlike("(?<![a-z0-9])(?:" + "|".join(rare) + ")(?![a-z0-9])"))
            .select("row_no", "doc_id", words.alias("words")))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(rare))
    rows = shared_table(rows.withColumn("places", places), "anchored")
    found = None
    for w in sorted({width(t) for t in templates.values()}):
        step, count = w // 2, bands(w)
        at = rows.select("row_no", "doc_id", "words", F.explode(_windows("places", w)).alias("window"))
        part = at.select("row_no", "doc_id", (F.col("window") * step).alias("first_word"), F.slice("words", F.col("window") * step + 1, w + SHINGLE - 1).alias("part"))
        part = part.where("size(part) > 0").withColumn("held", F.array_distinct(_hashes("part", F.greatest(F.lit(1), F.size("part") - SHINGLE + 1)))).drop("part")
        hashed = part.select("row_no", "doc_id", "first_word", "held", F.posexplode(_minima("held", count)).alias("band", "low"))
        table = known.where(F.col("width") == w).select("license", "known", F.posexplode(_minima("known", count)).alias("band", "low"))
        share = F.size(F.array_intersect("held", "known")) / F.size("known")
        hit = (hashed.join(F.broadcast(table), ["band", "low"]).withColumn("containment", share).where(F.col("containment") >= CONTAINMENT)
               .select("row_no", "doc_id", "license", "containment", "first_word"))
        found = hit if found is None else found.unionByName(hit)
    return (found.groupBy("row_no", "doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.min("first_word").cast("long").alias("first_word"))
            .drop("row_no"))


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same matches by exact containment of every window, without bands."""
    templates = TEMPLATES if templates is None else templates
    rows = ",\n  ".join(f"('{n}', '{s}', {width(t)}, {len(template_shingles(t))})" for n, t in templates.items() for s in template_shingles(t))
    return f"""
WITH t(license, shingle, width, m) AS (VALUES
  {rows}
), w AS (SELECT doc_id, row_number() OVER () AS row_no, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL
), p AS (SELECT row_no, doc_id, words, unnest(range(greatest(1, len(words) - {SHINGLE - 1}))) AS i FROM w
), s AS (SELECT row_no, doc_id, i, array_to_string(words[i + 1:i + {SHINGLE}], ' ') AS shingle FROM p
), h AS (
  SELECT row_no, doc_id, license, t.shingle, width, m, unnest(range(CAST(greatest(0, ceil((i - width + 1) / (width / 2.0))) AS BIGINT), CAST(floor(i / (width / 2.0)) AS BIGINT) + 1)) AS n
  FROM s JOIN t ON s.shingle = t.shingle
), c AS (SELECT row_no, doc_id, license, n * (width // 2) AS first_word, count(DISTINCT shingle) / m AS containment FROM h GROUP BY row_no, doc_id, license, n, width, m)
SELECT doc_id, license, round(max(containment), 6) AS containment, min(first_word) AS first_word
FROM c WHERE containment >= {CONTAINMENT} GROUP BY row_no, doc_id, license"""
