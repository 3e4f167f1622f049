"""License scan by MinHash bands over overlapping text windows.

Every length among the templates has its own windows: a little longer than the
template and so close together that each place where a template could stand lies
whole in one of them. Windows and templates that agree in a band of MinHash
values are compared exactly: the share of the template's shingles that the
window contains. The number of bands follows from the least Jaccard similarity of
a window that should match and the probability asked for.

Only windows that hold a shingle of some template are hashed, as others contain
nothing of any. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.shingles import SIZE, places, shingles, words
from fleetscope.session import broadcast_if_small, materialize, small_table

CONTAINMENT = 0.8
#: A window that contains enough of a template is retrieved with at least this probability.
RETRIEVED = 0.999
ROWS = 2

# Notices that grant or withhold rights, with the SPDX identifier of the license they name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bands(containment: float = CONTAINMENT, rows: int = ROWS, retrieved: float = RETRIEVED) -> int:
    """Bands needed. A window is at most 1/8 longer than its template; at the limit they share
    ``containment`` of the template's shingles out of all of both."""
    least = containment / (1 + 1 / 8 + 1 - containment)
    return math.ceil(math.log(1 - retrieved) / math.log(1 - least**rows))


def _banded(hashes: str, count: int):
    """(band, value) structs of the MinHash bands of a list of shingles."""
    low = f"array_min(transform({hashes}, h -> xxhash64(h, b * {ROWS} + r)))"
    value = f"xxhash64(transform(sequence(0, {ROWS - 1}), r -> {low}))"
    return F.expr(f"transform(sequence(1, {count}), b -> struct(b AS band, {value} AS value))")


def template_profiles(templates: DataFrame) -> DataFrame:
    """(license, template_id, size, own, n, reach, stride): templates as shingles, with the windows to lay.

    Templates shorter than five words are one shingle of all their words.
    """
    split = templates.select("license", "template_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    sizes = F.least(F.size("words"), F.lit(SIZE))
    own = F.coalesce(*[F.when(sizes == size, shingles("words", size)) for size in range(1, SIZE + 1)])
    out = split.select("license", "template_id", sizes.alias("size"), own.alias("own")).withColumn("n", F.size("own"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / 8)).cast("int")
    return out.withColumn("stride", stride).withColumn("reach", F.col("n") + F.col("stride") - 1)


def builtin_templates(spark: SparkSession) -> DataFrame:
    rows = [(name, i, text) for i, (name, text) in enumerate(TEMPLATES)]
    return small_table(spark, rows, "license string, template_id bigint, text string")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template_id, containment, start_word): where documents hold license templates.

    A window matches if it contains at least 0.8 of the template's distinct shingles.
    Of several windows of a document the best, then the first is given. Null and
    empty texts match nothing. Rows with one id count as one document, a null id
    included. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    profiles = materialize(template_profiles(builtin_templates(spark) if templates is None else templates), "license-templates")
    used = [r["size"] for r in profiles.select("size").distinct().collect()]
    split = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    seeds = profiles.select("size", "reach", "stride", F.explode("own").alias("seed")).distinct()
    windows = None
    for size in sorted(used):
        own = broadcast_if_small(seeds.where(F.col("size") == size))
        found = places(split.select("doc_id", shingles("words", size).alias("hashes")), "hashes").join(own, F.col("hash") == F.col("seed"))
        # starts of the windows on the grid that hold this place
        first = F.ceil((F.col("place") - F.col("reach") + 1) / F.col("stride"))
        last = F.floor(F.col("place") / F.col("stride"))
        starts = F.transform(F.sequence(F.greatest(first, F.lit(0)), last), lambda x: x * F.col("stride"))
        cut = F.expr("transform(starts, s -> struct(s AS start, slice(hashes, cast(s + 1 AS int), reach) AS window))")
        found = found.withColumn("starts", starts).select("doc_id", "size", "reach", F.explode(cut).alias("w"))
        found = found.select("doc_id", "size", "reach", "w.start", "w.window").distinct()
        windows = found if windows is None else windows.unionByName(found)
    if windows is None:
        return docs.limit(0).select(F.col(id_col).alias("doc_id")).selectExpr(
            "doc_id", "'' AS license", "0L AS template_id", "0.0D AS containment", "0L AS start_word"
        )
    windows = materialize(windows, "license-windows")
    count = bands()
    kinds = ["size", "reach"]
    asked = windows.select(*kinds, "window").distinct().select(*kinds, "window", F.explode(_banded("window", count)).alias("b"))
    index = profiles.select(*kinds, "license", "template_id", "own", "n", F.explode(_banded("own", count)).alias("b"))
    pairs = asked.select(*kinds, "window", "b.band", "b.value").join(
        broadcast_if_small(index.select(*kinds, "license", "template_id", "own", "b.band", "b.value")), [*kinds, "band", "value"]
    )
    pairs = pairs.select(*kinds, "window", "license", "template_id", "own").distinct()
    held = F.size(F.array_intersect("own", "window")) / F.size(F.array_distinct("own"))
    scored = pairs.select(*kinds, "window", "license", "template_id", held.alias("containment"))
    scored = materialize(scored.where(F.col("containment") >= CONTAINMENT), "license-matches")
    best = F.max(F.struct("containment", (-F.col("start")).alias("before"))).alias("best")
    out = windows.join(scored, [*kinds, "window"]).groupBy("doc_id", "license", "template_id").agg(best)
    return out.select("doc_id", "license", "template_id", F.col("best.containment").alias("containment"), (-F.col("best.before")).alias("start_word"))
