"""License notices in texts: MinHash bands over overlapping windows, then exact containment of shingles."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.llm.license_texts import STANDARD, WHOLE

SHINGLE = 5
CONTAINMENT = 0.8
MISSED = 1e-4
# Short lines and parts of grants, whole licenses and standard notices, by name.
NOTICES = {
    "MIT notice": "Released under the MIT License.",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache 2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL 3 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                      "provided that the following conditions are met",
    "Apache 2.0 grant": "you may not use this file except in compliance with the License. You may obtain a copy of the "
                        "License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation",
    **WHOLE, **STANDARD,
}


def once(value: Column) -> Column:
    """A value that is worked out once per row: as a generator's output it is never put in place of its uses."""
    return F.explode(F.array(value))


def shingled(rows: DataFrame, text: str, *others: str | Column) -> DataFrame:
    """``others`` and ``shingles``: hashes of the runs of five words in order; words are letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    kept = [f"__{i}" for i in range(len(others))]
    cut = rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(others, kept)], once(words).alias("__words"))
    runs = F.transform("__words", lambda w, i: F.xxhash64(F.slice("__words", i + 1, SHINGLE)))
    return cut.select(*kept, once(F.slice(runs, F.lit(1), F.greatest(F.size("__words") - (SHINGLE - 1), F.lit(0)))).alias("shingles"))


def window_sizes(count: int) -> tuple[int, int]:
    """Length and step, in shingles, of the windows for a template of ``count`` shingles.

    A step that is a power of two from ``count`` on, and twice that as length: every run of ``count``
    shingles lies whole in one of the windows.
    """
    step = 1 << max(0, (count - 1).bit_length())
    return 2 * step, step


def bands_for(containment: float = CONTAINMENT, missed: float = MISSED) -> int:
    """Bands of one row each such that a window is missed with at most this probability.

    The worst template has just over half as many shingles as the step; with the share
    ``containment`` of it in a window of twice the step, the Jaccard similarity is at least
    containment / (4 + (1 - containment)).
    """
    similarity = containment / (5 - containment)
    return math.ceil(math.log(missed) / math.log(1 - similarity))


def salt(band: int) -> int:
    """Odd 64-bit constant of a band: an exclusive-or with it puts the hashes in another order."""
    mixed = ((band + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
    mixed = ((mixed ^ (mixed >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64) | 1
    return mixed - (1 << 64) if mixed >> 63 else mixed


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: Mapping[str, str] = NOTICES,
         containment: float = CONTAINMENT, missed: float = MISSED) -> DataFrame:
    """``doc_id, text_key, notice, containment, start, n_shingles``: notices of which a window holds enough.

    A window's signature has one minimum per band; a band retrieves a template when both have the
    same minimum there, which is then one shingle of both. So a window without any shingle that is a
    template's minimum retrieves nothing, and signatures are made only for texts that hold one: the
    filter loses no retrieval. The templates are parameters and do not grow with the data; their
    minima travel as constants. Each retrieved window is verified by the exact share of the
    template's shingles in it, and the best window of a text and template is returned, the first of
    equals; ``start`` is the number of its first shingle, from 0.

    Missing and empty texts and those of under five words hold nothing, and such notices are left out. Rows that repeat id and text
    give one answer. An empty table gives no rows.
    """
    bands = bands_for(containment, missed)
    named = docs.sparkSession.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in notices.items() for x in pair]))
                                              .alias("notice", "body"))
    # A handful of rows that only the parameters determine.
    templates = shingled(named, "body", "notice").toDF("notice", "shingles") \
        .select("notice", F.array_distinct("shingles").alias("shingles")) \
        .select("notice", "shingles", _minima("shingles", bands).alias("minima")).filter(F.size("shingles") > 0) \
        .orderBy("notice").collect()
    if not templates:
        raise ValueError("no notice has five words")
    known = F.array(*[F.struct(F.lit(t.notice).alias("notice"), F.lit(window_sizes(len(t.shingles))[0]).alias("length"),
                               _constants(t.shingles).alias("shingles"), _constants(t.minima).alias("minima")) for t in templates])
    wanted = _constants(sorted({m ^ salt(b) for t in templates for b, m in enumerate(t.minima)}))
    sizes = F.array(*[F.struct(F.lit(length).alias("length"), F.lit(step).alias("step"))
                      for length, step in sorted({window_sizes(len(t.shingles)) for t in templates})])
    rows = shingled(docs, text, doc_id, F.xxhash64(text)).toDF("doc_id", "text_key", "shingles")
    held = rows.filter(F.arrays_overlap("shingles", wanted))

    def cut(size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), size["step"])
        all_windows = F.transform(starts, lambda at: F.struct(size["length"].alias("length"), at.alias("start"),
                                                              F.slice("shingles", at + 1, size["length"]).alias("held")))
        return F.filter(all_windows, lambda w: F.arrays_overlap(w["held"], wanted))

    windows = held.select("doc_id", "text_key", F.explode(F.flatten(F.transform(sizes, cut))).alias("w")) \
        .select("doc_id", "text_key", "w.*")
    signatures = windows.select("*", once(_minima("held", bands)).alias("minima"))

    def retrieved(t: Column) -> Column:
        alike = F.exists(F.zip_with("minima", t["minima"], lambda a, b: a == b), lambda same: same)
        return (t["length"] == F.col("length")) & alike

    # The exact share is worked out only where a band has retrieved the template.
    hits = F.transform(F.filter(known, retrieved), lambda t: F.struct(t["notice"].alias("notice"), (F.size(
        F.array_intersect(F.col("held"), t["shingles"])) / F.size(t["shingles"])).alias("containment")))
    found = signatures.select("doc_id", "text_key", "start", F.size("held").alias("n_shingles"), F.explode(hits).alias("hit")) \
        .filter(F.col("hit.containment") >= containment)
    best = found.groupBy("doc_id", "text_key", "hit.notice").agg(
        F.max(F.struct("hit.containment", (-F.col("start")).alias("back"), "n_shingles")).alias("best"))
    return best.select("doc_id", "text_key", "notice", "best.containment", (-F.col("best.back")).alias("start"),
                       "best.n_shingles")


def _minima(hashes: str, bands: int) -> Column:
    """The smallest hash of a set in the order of each band."""
    return F.transform(_constants([salt(b) for b in range(bands)]),
                       lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def _constants(hashes: list[int]) -> Column:
    """An array as one literal, which the planner folds: whole licenses have tens of thousands of hashes."""
    return F.split(F.lit(",".join(map(str, hashes))), ",").cast("array<bigint>")
