"""License scan in DataFrame operations: MinHash bands over text windows,
then exact shingle containment.

A template of n five-word shingles is looked for in windows of n + stride - 1
shingles, ``stride`` apart, so that a copy of it lies whole in some window.
Band b of a set is its least shingle hash after XOR with a constant of the
band (one row a band). ``bands_for`` gives so many bands that a window
holding 0.8 of a template collides with probability 0.999 or more. Windows
that collide are verified by the share of the template's shingles they hold.

A window can only collide if it holds a band's least shingle of the template,
so windows are built only around those; that changes no collision.
Words are runs of letters and digits, lower case.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-3
#: Band hashes of all templates up to which a scan tests them as a literal
#: set and sends the template table to every task; beyond it both are joins.
MAX_LITERAL = 4_096

#: Public license notices looked for by the registered query (fixed values).
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license_id string, text string")


def stride_of(shingles: int) -> int:
    return max(1, shingles // 4)


def bands_for(containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row so that the Jaccard similarity of a window with
    ``containment`` of the template, at its least, is missed that rarely."""
    jaccard = containment / (1 + 0.25 + 1 - containment)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def shingled(df: DataFrame) -> DataFrame:
    """``df`` with ``sh``, the hashes of the five-word shingles of ``text`` by
    position, in place of it; empty for shorter texts."""
    rest = [c for c in df.columns if c != "text"]
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n = F.size("words") - (SHINGLE - 1)
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    return df.select(*rest, words.alias("words")).select(*rest, F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>")).alias("sh"))


def _salt(band):
    return F.xxhash64(band, F.lit(1))


def _least(hashes, salt):
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(salt)))


def signatures(templates: DataFrame, bands: int) -> DataFrame:
    """(license_id, n, stride, grams, band, salt, least, key): one row for
    each template and band; ``key`` is the shingle that gives ``least``."""
    grams = (shingled(templates.where("license_id is not null and text is not null").select("license_id", "text"))
             .select("license_id", F.array_distinct("sh").alias("grams")))
    n = F.size("grams")
    return (grams.where(n > 0).select("license_id", "grams", n.alias("n"), F.greatest(F.lit(1), F.floor(n / 4)).cast("int").alias("stride"),
                                      F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
            .withColumn("salt", _salt(F.col("band"))).withColumn("least", _least(F.col("grams"), F.col("salt")))
            .withColumn("key", F.col("least").bitwiseXOR(F.col("salt"))))


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, max_literal: int = MAX_LITERAL) -> DataFrame:
    """(doc_id, license_id, containment, first_shingle, windows): for each
    document and template found its best window, the first of equals, and how
    many windows held the template.

    Null texts and texts or templates of under five words match nothing; a
    null doc_id stays null. Rows that repeat doc_id and text are reported
    once, rows that repeat only doc_id each. Empty tables give no rows.
    """
    sig = written(signatures(templates, bands_for(containment)))
    keys = [r["key"] for r in sig.select("key").distinct().limit(max_literal + 1).collect()]
    small = len(keys) <= max_literal
    read = shingled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"))
    hits = F.transform("sh", lambda h, i: F.struct(h.alias("key"), i.alias("at")))
    if small:
        known = F.array(*[F.lit(k) for k in keys]).cast("array<bigint>")
        hits = F.when(F.arrays_overlap("sh", known), F.filter(hits, lambda x: x["key"].isin(keys)))
    # The outer form keeps Spark from testing, hence computing, hits twice.
    placed = (read.select("doc_id", "text_hash", "sh", hits.alias("hits")).select("doc_id", "text_hash", "sh", F.inline_outer("hits"))
              .join(F.broadcast(sig) if small else sig, "key"))
    width = F.col("n") + F.col("stride") - 1
    first = F.floor(F.greatest(F.lit(0), F.col("at") - width + F.col("stride")) / F.col("stride"))
    starts = placed.withColumn("nth", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("stride")))))
    window = F.slice("sh", (F.col("nth") * F.col("stride") + 1).cast("int"), width.cast("int"))
    collided = starts.withColumn("window", window).where(_least(F.col("window"), F.col("salt")) == F.col("least"))
    share = F.size(F.array_intersect("window", "grams")) / F.col("n")
    found = (collided.select("doc_id", "text_hash", "license_id", (F.col("nth") * F.col("stride")).alias("start"), share.alias("share"))
             .where(F.col("share") >= containment).distinct())
    return (found.groupBy("doc_id", "text_hash", "license_id")
            .agg(F.max("share").alias("containment"), F.min(F.struct(-F.col("share"), F.col("start"))).alias("best"), F.count(F.lit(1)).alias("windows"))
            .select("doc_id", "license_id", "containment", F.col("best.start").cast("long").alias("first_shingle"), "windows"))
