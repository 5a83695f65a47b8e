"""License scans: MinHash bands over overlapping word windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm.common import row_key

CONTAINED, BANDS = 0.8, 32
# Fixed texts: notices by which works name their license.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = "[a-z0-9]+"


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def anchors(contained: float = CONTAINED) -> list[str]:
    """Words of which every sufficient match holds one: in each template, the longest whose shingles are more than may be missing."""
    out = set()
    for text in TEMPLATES.values():
        words = re.findall(_WORD, text.lower())
        pairs, chosen = _pairs(words), set()
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            chosen.add(w)
            if sum(bool(chosen & set(p)) for p in pairs) > (1 - contained) * len(pairs) + 1e-9:
                break
        out |= chosen
    return sorted(out)


def _shingles(words: Column) -> Column:
    """Distinct hashes of the two-word shingles."""
    n = F.size(words)
    return F.when(n >= 2, F.array_distinct(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(a, b)))).otherwise(
        F.array().cast("array<long>"))


def _bands(shingles: Column) -> Column:
    """One minimum per band, the band's number mixed in, so that a shared value is a shared bucket."""
    def least(i):
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(i))))

    return F.array(*[F.xxhash64(F.lit(i), least(i)) for i in range(BANDS)])


def template_table(spark: SparkSession) -> DataFrame:
    """(license, len, t_shingles, t_bands), one row per entry of TEMPLATES."""
    rows = spark.createDataFrame(list(TEMPLATES.items()), "license string, said string")
    words = F.regexp_extract_all(F.lower("said"), F.lit(_WORD), F.lit(0))
    rows = rows.select("license", F.size(words).alias("len"), _shingles(words).alias("t_shingles"))
    return rows.withColumn("t_bands", _bands(F.col("t_shingles")))


def find_licenses(docs: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(key, license, containment, start): per text and license the window that holds most of the template (the first of equals), if at least `contained` of its shingles.

    Windows are twice as long as a template and start every template length, so an occurrence lies whole in one. A window that
    holds 0.8 of a template then has a Jaccard similarity of at least 0.8 / 2.2 with it; 32 bands of one minimum miss that
    with a probability under 1e-6. Texts without any anchor word, and windows without one, hold no sufficient match.
    Start counts words from 0.
    """
    keys = anchors(contained)
    templates = F.broadcast(template_table(docs.sparkSession))  # as long as TEMPLATES
    lengths = sorted({len(re.findall(_WORD, t.lower())) for t in TEMPLATES.values()})
    lower = F.lower("text")
    texts = (docs.filter(lower.rlike("|".join(keys))).select(row_key("doc_id", "text").alias("key"), lower.alias("text")).dropDuplicates(["key"])
             .select("key", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words")))
    rows = texts.select("key", "words", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("len"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col("words"), s + 1, F.col("len") * 2).alias("window")))
    held = F.filter(cut, lambda w: F.arrays_overlap(w["window"], F.array(*[F.lit(k) for k in keys])))  # before the rows multiply
    windows = rows.select("key", "len", F.explode(held).alias("w")).select(
        "key", "len", F.col("w.start").alias("start"), _shingles(F.col("w.window")).alias("shingles"))
    windows = windows.filter(F.size("shingles") > 0).withColumn("bands", _bands(F.col("shingles")))
    met = windows.join(templates, "len").filter(F.arrays_overlap("bands", "t_bands"))
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    return (met.withColumn("containment", share).filter(F.col("containment") >= contained - 1e-9)
            .groupBy("key", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
            .select("key", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("start")))


def scan_licenses(docs: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, n_licenses, matches) per row of `docs`; matches are structs (license, containment, start), by license.

    Null and empty texts match nothing; repeated rows are scanned alike; further columns are not read.
    """
    per = find_licenses(docs, contained).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("license", "containment", "start"))).alias("matches"))  # of a text at most one per template
    rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id").join(per, "key", "left")
    return rows.select("doc_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_licenses"), "matches")
