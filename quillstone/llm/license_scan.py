"""License scan, in DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; shingles are 5 words (a shorter
template is one shingle).  Documents are cut into overlapping windows of ``2 L`` shingles every ``L``, one set of
windows for each template length class L (a power of two, ``least_class`` at least), so that every occurrence of a
template lies within a window.  Windows and templates are MinHashed; each of ``bands`` bands is one row, which
for a template that fills ``share`` of a window retrieves it with probability 1 - (1 - share) ** bands.  Retrieved
pairs are verified by exact containment: the share of the template's shingles found in the window, ``threshold`` or
more.

Two lossless cuts keep most of a corpus out of the MinHash.  A match misses at most ``1 - threshold`` of a template's n
distinct shingles, so it holds one of any ``floor((1 - threshold) n) + 1`` of them: those with the longest longest words give a
template's anchor words, and a text without any anchor matches nothing.  A window without any template shingle has
similarity 0 to all of them.

Bounds: the template table goes to every executor as one array and is refused above ``most_shingles`` shingles.

Cases: null or empty texts, and an empty template table, give an empty list; a template without words is ignored;
equal templates under two names are both reported; repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Notices of common licences (license_id, text).
TEMPLATES = [
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-line", "Released under the BSD License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc-nd-4.0-line", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-sa-4.0-line", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nd-4.0-line", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0-1.0-line", "Licensed under CC0 1.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit-line", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def fixed(c: Column) -> Column:
    """``c`` made once a row: a generator, through which the optimizer moves no expression into filters or lambdas."""
    return F.explode(F.array(c))


def shingles_of(words: Column, n: Column) -> Column:
    """Hashes of all n-word shingles; of fewer words, none."""
    return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))
    )


def min_hashes(shingles: Column, bands: int) -> Column:
    """The minimum of the shingles' hashes under each of ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def prepared(templates: DataFrame, threshold: float, least_class: int, bands: int) -> DataFrame:
    """license_id, width (words of a shingle), class, shingles, mins, anchors."""
    t = templates.select("license_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    t = t.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    spans = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.slice("words", i, F.col("width")))
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    t = t.select("license_id", "width", F.array_distinct(spans).alias("spans"))
    ranked = F.sort_array(F.transform("spans", longest), asc=False)
    anchors = F.transform(F.slice(ranked, 1, F.floor(F.size("spans") * (1 - threshold) + 1e-9).cast("int") + 1), lambda x: x["w"])
    t = t.select("license_id", "width", anchors.alias("anchors"), F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s))).alias("shingles"))
    size = F.size("shingles")
    cls = F.greatest(F.lit(least_class), F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int"))
    return t.select("license_id", "width", cls.alias("class"), "anchors", "shingles").withColumn("mins", min_hashes(F.col("shingles"), bands))


def matches(docs: DataFrame, templates: DataFrame, threshold: float = 0.8, bands: int = 48, least_class: int = 4, most_shingles: int = 20_000) -> DataFrame:
    """row_id, doc_id, license_id, containment: the templates of each document that has any (docs: row_id, doc_id, text)."""
    t = prepared(templates, threshold, least_class, bands)
    facts = t.agg(
        F.collect_set(F.struct("width", "class")).alias("kinds"), F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"),
        F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"),
    ).first()  # one row, bounded by most_shingles
    if facts["n"] > most_shingles:
        raise ValueError(f"{facts['n']} template shingles; most_shingles is {most_shingles}")
    some = F.lit(False)
    for a in sorted(facts["anchors"], key=lambda a: (-len(a), a)):
        some = some | F.contains(F.col("low"), F.lit(a))
    near = docs.select("row_id", "doc_id", "text", fixed(lower_ascii(F.col("text"))).alias("low")).where(some).select("row_id", "doc_id", fixed(words_of(F.col("text"))).alias("words"))
    if not facts["kinds"]:
        return near.select("row_id", "doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment")).where(F.lit(False))
    known = t.agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("a")).scalar()
    kinds = F.array(*[F.struct(F.lit(k["width"]).alias("width"), F.lit(k["class"]).alias("class")) for k in sorted(facts["kinds"])])
    rows = near.select("row_id", "doc_id", "words", F.explode(kinds).alias("kind")).select("row_id", "doc_id", "kind.width", "kind.class", fixed(shingles_of(F.col("words"), F.col("kind.width"))).alias("sh"))
    rows = rows.select("*", fixed(F.array_intersect("sh", known)).alias("present")).where(F.size("present") > 0)
    at = F.filter(F.transform("sh", lambda h, i: F.when(F.array_contains("present", h), i)), lambda i: i.isNotNull())
    cls = F.col("class")
    starts = F.transform(at, lambda i: F.array(F.floor(i / cls) * cls, F.greatest((F.floor(i / cls) - 1) * cls, F.lit(0))))
    windows = rows.select("row_id", "doc_id", "width", "class", "sh", F.explode(F.array_distinct(F.flatten(starts))).alias("start"))
    windows = windows.select("row_id", "doc_id", "width", "class", fixed(F.slice("sh", F.col("start").cast("int") + 1, 2 * cls)).alias("win"))
    keyed = windows.select("row_id", "doc_id", "width", "class", "win", F.posexplode(min_hashes(F.col("win"), bands)).alias("band", "value"))
    sought = t.select("license_id", "width", "class", "shingles", F.posexplode("mins").alias("band", "value"))
    pairs = keyed.join(F.broadcast(sought), ["width", "class", "band", "value"])
    share = F.size(F.array_intersect("shingles", "win")) / F.size("shingles")
    found = pairs.select("row_id", "doc_id", "license_id", share.alias("containment")).where(F.col("containment") >= threshold)
    return found.groupBy("row_id", "doc_id", "license_id").agg(F.max("containment").alias("containment"))


def scanned(docs: DataFrame, templates: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, licenses (array of struct license_id, containment; sorted by id)."""
    rows = docs.select(F.xxhash64("text").alias("row_id"), "doc_id", "text")
    held = matches(rows, templates, **options).groupBy("row_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("license_id", "containment"))).alias("licenses"))
    held = held.select(F.col("row_id").alias("r"), F.col("doc_id").alias("d"), "licenses")
    out = rows.select("row_id", "doc_id").join(held, F.col("row_id").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<struct<license_id:string,containment:double>>")).alias("licenses"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def result(docs: DataFrame) -> DataFrame:
    """The columns of query op5: doc_id, n_licenses, licenses (ids, comma-joined), containment (least of them)."""
    out = scanned(docs, default_templates(docs.sparkSession))
    ids = F.transform("licenses", lambda x: x["license_id"])
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(ids, ",").alias("licenses"), F.array_min(F.transform("licenses", lambda x: x["containment"])).alias("containment"))


def retrieval_probability(share: float, bands: int) -> float:
    return -math.expm1(bands * math.log1p(-share)) if share < 1 else 1.0


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT id, {_WORDS} AS w FROM (VALUES {_VALUES}) AS v(id, text)),
ts AS (SELECT DISTINCT id, k, list_slice(w, p, p + k - 1) AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT id, w, least(len(w), 5) AS k FROM t))),
tn AS (SELECT id, count(*) AS n, greatest(4, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT)) AS c FROM ts GROUP BY id),
ds AS (SELECT r, k, p - 1 AS p, list_slice(w, p, p + k - 1) AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ts) WHERE len(w) >= k)),
h AS (SELECT r, ts.id, n, p // c AS win, ds.s FROM ds JOIN ts ON ds.k = ts.k AND ds.s = ts.s JOIN tn ON tn.id = ts.id),
g AS (SELECT r, id, count(DISTINCT s) / any_value(n) AS share FROM (SELECT * FROM h UNION ALL SELECT r, id, n, win - 1, s FROM h WHERE win > 0) GROUP BY r, id, win),
b AS (SELECT r, id, max(share) AS share FROM g GROUP BY r, id HAVING max(share) >= 0.8),
f AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, min(share) AS share FROM b GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(ids, '') AS licenses, share AS containment FROM d LEFT JOIN f USING (r)
"""
