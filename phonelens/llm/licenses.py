"""Operator 10: license scans with built-in Spark functions only.

Texts are cut into overlapping windows of word shingles; a window and a
template are signed by MinHash bands of one row; equal bands retrieve the
template, and exact containment of the template's shingles in the window
verifies it.

Why the bands suffice: a template of t shingles that lies in a document to
the threshold lies in some window of 2w shingles (w: at least the template's
length; windows start every w).  The window then shares s >= 0.8 t of at most
2w + t - s shingles, and each of the B bands agrees with a probability of
the Jaccard similarity J = s / (2w + t - s); B is set for each length class
so that (1 - J) ** B < ``miss``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-4
SEED_STEP = 7919

# Customary license notices.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of "
                        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                        "of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved. No part of this text may be reproduced without written permission.",
}

# One translate() makes words: ASCII lower case, white space to blanks, marks dropped.
FROM_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r.,;:()\"'"
TO_CHARS = "abcdefghijklmnopqrstuvwxyz     "
MAX_TEMPLATES = 10_000  # their signatures are broadcast and their minima are literals


def size_class(t: int) -> int:
    """Upper end of a template's length class: 1, 2, 3, 4, 8, 16, 32, ... shingles."""
    return t if t <= 4 else 1 << (t - 1).bit_length()


def grid(top: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(window, stride, bands) of a length class, in shingles."""
    if top <= 4:
        low, stride = top, 1  # 80 % of up to four shingles is all of them
    else:
        low, stride = (4 if top == 8 else top // 2) + 1, top // 4
    window = top + stride - 1
    j = min(s / (window + t - s) for t in range(low, top + 1) for s in [math.ceil(threshold * t)])
    return window, stride, 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(" ", text.translate(str.maketrans(
        FROM_CHARS, TO_CHARS + "\0" * (len(FROM_CHARS) - len(TO_CHARS)))).replace("\0", "")) if w]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, FROM_CHARS, TO_CHARS), " "), "")


def _shingle_hashes(words: str) -> Column:
    n = F.size(words)
    side = F.arrays_zip(*[F.slice(words, k + 1, n - (SHINGLE - 1)).alias(f"w{k}") for k in range(SHINGLE)])
    return F.when(n >= SHINGLE, F.transform(side, lambda x: F.xxhash64(x)))


def _signature(hashes: Column, bands: Column) -> Column:
    """Per band the least seeded hash, with the shingle hash that has it."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(
        F.transform(hashes, lambda x: F.struct(F.xxhash64(x, k * SEED_STEP).alias("v"), x.alias("x")))))


def _signed_templates(spark: SparkSession, templates: dict[str, str], threshold: float) -> list[tuple]:
    """(name, shingles, class, signature) of each template, by the same
    expressions that sign windows; at most MAX_TEMPLATES rows come back."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates, not {len(templates)}")
    by: dict[int, list[tuple]] = {}
    for name, text in templates.items():
        w = template_words(text)
        if len(w) < SHINGLE:
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
        shingles = sorted({" ".join(w[i: i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
        by.setdefault(size_class(len(shingles)), []).append((name, w, shingles))
    out = []
    for top, rows in sorted(by.items()):
        df = spark.createDataFrame(rows, "license string, w array<string>, shingles array<string>")
        df = df.withColumn("h", _shingle_hashes("w")).select(
            "license", "shingles", _signature(F.col("h"), F.lit(grid(top, threshold)[2])).alias("sig"))
        out += [(r.license, r.shingles, top, [(s.v, s.x) for s in r.sig]) for r in df.collect()]
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_template (its shingles), n_shared (most found in one
    window) and first_word (least start of such a window) for every document
    and template with n_shared >= threshold * n_template.

    Shingles are five words in ASCII lower case without sentence marks.  NULL,
    empty and shorter texts match nothing; rows with one doc_id report
    together; no template or no row gives no result.  Only matches are
    shuffled; texts stay in the task that reads them, and a document without
    any template minimum is dropped by one array test."""
    spark = docs.sparkSession
    signed = _signed_templates(spark, TEMPLATES if templates is None else templates, threshold)
    schema = "doc_id long, license string, n_template long, n_shared long, first_word long"
    if not signed:
        return spark.createDataFrame([], schema)
    anchors = sorted({x for *_, sig in signed for _, x in sig})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    # inline() is a barrier: hashes are made once, and the array test reads them
    d = d.select("doc_id", "w", F.inline(F.array(F.struct(_shingle_hashes("w").alias("h")))))
    d = d.filter(F.arrays_overlap("h", F.array(*[F.lit(x) for x in anchors])))
    out = _matches(d, signed, threshold)
    best = out.groupBy("doc_id", "license", "n_template").agg(
        F.max(F.struct("n_shared", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "license", F.col("n_template").cast("long").alias("n_template"),
                       F.col("m.n_shared").cast("long").alias("n_shared"), (-F.col("m.s")).cast("long").alias("first_word"))


def _windows(signed: list[tuple], top: int, threshold: float) -> Column:
    """The windows of a length class that hold a minimum of one of its
    templates: no other window can share a band."""
    window, stride, bands = grid(top, threshold)
    anchors = sorted({x for *_, t, sig in signed if t == top for _, x in sig})
    hits = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i).isin(anchors))
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - (window - 1)) / F.lit(stride)).cast("int"))
    at = F.flatten(F.transform(hits, lambda i: F.sequence(first(i), F.floor(i / F.lit(stride)).cast("int"))))
    return F.transform(F.array_distinct(at), lambda g: F.struct(
        F.lit(top).alias("top"), F.lit(bands).alias("bands"), (g * stride).alias("start"),
        F.least(g * stride + window, F.size("h")).alias("stop")))


def _matches(d: DataFrame, signed: list[tuple], threshold: float) -> DataFrame:
    spark = d.sparkSession
    tops = sorted({t for *_, t, _ in signed})
    d = d.select("doc_id", "w", "h", F.inline(F.concat(*[_windows(signed, t, threshold) for t in tops])))
    place = F.sequence(F.col("start"), F.col("stop") - 1)
    text = F.transform(place, lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(SHINGLE)]))
    d = d.select("doc_id", "top", "bands", "start", F.inline(F.array(F.struct(
        F.transform(place, lambda i: F.get("h", i)).alias("own"), F.array_distinct(text).alias("text")))))
    d = d.select("doc_id", "top", "start", "text", F.posexplode(_signature(F.col("own"), F.col("bands"))).alias("band", "m"))
    d = d.select("doc_id", "top", "start", "text", "band", F.col("m.v").alias("v"))
    known = spark.createDataFrame([(name, shingles, top, k, v) for name, shingles, top, sig in signed
                                   for k, (v, _) in enumerate(sig)],
                                  "license string, shingles array<string>, top int, band int, v long")
    got = d.join(F.broadcast(known), ["top", "band", "v"])
    shared = F.size(F.array_intersect("text", "shingles"))
    got = got.select("doc_id", "start", "license", F.size("shingles").alias("n_template"), shared.alias("n_shared"))
    return got.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_template"))
