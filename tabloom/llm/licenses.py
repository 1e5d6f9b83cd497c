"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

A text is split into lower-case words; shingles are hashes of five words. For each template length, windows
of that many shingles overlap by seven eighths. A window shares a band with a template with probability
1 - (1 - J)^BANDS, where J is their Jaccard similarity (bands of one row). A region that holds 0.8 of a
template's shingles has J >= 0.53 with the best window, so it is found with probability 1 - 3e-11; the found
region, one step wider on either side, is then compared exactly: |shingles of both| / |template| >= 0.8.

Two conditions that follow from a shared band come first, so that they lose nothing: a document must hold one
of the words that hit every template shingle, and a window must hold a template shingle.

Templates are a bounded parameter (name, text of five words or more). Null, empty and short texts match
nothing; repeated rows are reported once per id; a null id is an id. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SHINGLE_WORDS = 5
BANDS = 32
CONTAINMENT = 0.8
#: Bound on the shingles of all templates together: they are broadcast and stand in the plan.
MOST_SHINGLES = 20_000

# Notices that published licenses ask for, by identifier.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the runs of five words, in order."""
    last = F.size(words) - SHINGLE_WORDS
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, SHINGLE_WORDS)))).otherwise(F.array().cast("array<bigint>"))


def _signature(window: Column) -> Column:
    """The least seeded hash of the window for each band."""
    return F.transform(F.array(*map(F.lit, range(BANDS))), lambda k: F.array_min(F.transform(window, lambda x: F.xxhash64(x, k))))


def _hitting(shingles: list[list[str]]) -> list[str]:
    """Words of which every shingle holds one; greedily those in the most shingles, rare-looking ones first."""
    left, chosen = [set(s) for s in shingles], []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for word in s:
                counts[word] = counts.get(word, 0) + 1
        best = max(sorted(counts), key=lambda w: (counts[w] if len(w) > 4 else 0, len(w)))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: key, license, containment, first_word, n_windows."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    known = known.withColumn("words", _words(F.col("text"))).withColumn("shingles", F.array_distinct(_shingles(F.col("words"))))
    rows = known.select("license", "words", "shingles").collect()
    if short := [r.license for r in rows if not r.shingles]:
        raise ValueError(f"Templates of fewer than {SHINGLE_WORDS} words: {short}")
    if sum(len(r.shingles) for r in rows) > MOST_SHINGLES:
        raise ValueError(f"Templates of more than {MOST_SHINGLES} shingles")
    hitting = _hitting([r.words[i : i + SHINGLE_WORDS] for r in rows for i in range(len(r.words) - SHINGLE_WORDS + 1)])
    lengths = sorted({len(r.shingles) for r in rows})

    held = docs.select(F.col(key).alias("key"), _words(F.col(text)).alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, hitting))))
    held = held.withColumn("shingles", _shingles(F.col("words")))

    def windows(n: int) -> Column:
        """The windows of ``n`` shingles that hold a shingle of a template of that length."""
        step = max(1, n // 8)
        values = sorted({s for r in rows if len(r.shingles) == n for s in r.shingles})
        shingles = F.col("shingles")
        places = F.when(F.size(shingles) > 0, F.sequence(F.lit(0), F.size(shingles) - 1)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(places, lambda i: F.get(shingles, i).isin(values))
        steps = F.array(*map(F.lit, range(-(-n // step))))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.transform(steps, lambda j: F.greatest(F.lit(0), F.floor(p / step).cast("int") - j) * step))))
        return F.transform(
            starts,
            lambda s: F.struct(
                F.lit(n).alias("n"),
                s.alias("start"),
                F.slice(shingles, s + 1, n).alias("window"),
                F.slice(shingles, F.greatest(s - step, F.lit(0)) + 1, n + 2 * step).alias("wide"),
            ),
        )

    found = held.select("key", F.explode(reduce(F.concat, map(windows, lengths))).alias("w")).select("key", "w.*")
    bands = found.select("key", "n", "start", "wide", F.posexplode(_signature(F.col("window"))).alias("band", "least"))
    retrieved = known.select("license", F.col("shingles").alias("whole"), F.posexplode(_signature(F.col("shingles"))).alias("band", "least")).withColumn("n", F.size("whole"))
    # The templates have at most MOST_SHINGLES shingles, checked above.
    pairs = bands.join(F.broadcast(retrieved), ["n", "band", "least"])
    share = F.size(F.array_intersect("wide", "whole")) / F.size("whole")
    return (
        pairs.withColumn("containment", share)
        .where(F.col("containment") >= containment)
        .groupBy("key", "license")
        .agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"), F.count_distinct("start").alias("n_windows"))
        .withColumnRenamed("key", key)
    )
