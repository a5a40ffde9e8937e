"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case; shingles have five words (a template of fewer words is one shingle of its own length).
A template of fewer than ``WINDOW`` shingles is looked up shingle by shingle. Of longer ones, all windows of ``WINDOW`` shingles are
indexed, and the text is cut into windows of the same length at half that distance. Each window has ``BANDS`` bands of one MinHash; with
a Jaccard index of j a band collides with probability j, so a window is retrieved with probability 1 - (1 - j) ** 8: a copy
always holds a window equal to an indexed one once it has 11 shingles, and at least 1 - 0.4 ** 8 = 0.9993 below; where a
fifth of the shingles differ, each window still has j >= 0.45, that is 0.992.
A match needs ``CONTAINMENT`` of the template's shingles in the aligned stretch of the text.

The catalogue is small and the same for all inputs: it is the only thing that is sent to every executor.

Defined results: a null or empty text has no license; one row for each document id and license, with the best containment and the first
place; repeated rows give one.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let

SHINGLE, WINDOW, BANDS, CONTAINMENT = 5, 8, 8, 0.8
_STRIDE, _TURN = WINDOW // 2, 7

#: Notices by which licenses are commonly declared.
CATALOGUE = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("All-rights-reserved", "All rights reserved."),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.lit([]).cast("array<int>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, from the hashes of the words."""
    return F.transform(_starts(F.size(hashes), width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))


def shingles(words: Column, width: int) -> Column:
    return F.transform(_starts(F.size(words), width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def _values(hashes: Column, length: int) -> Column:
    """MinHash of every band over ``length`` hashes; each band has an order of its own: a shift brings lower bits to the front."""
    return F.array(*[F.least(*[F.shiftleft(F.get(hashes, F.lit(i)), band * _TURN) for i in range(length)]) for band in range(BANDS)])


def templates(spark: SparkSession, catalogue: Sequence[tuple[str, str]]) -> DataFrame:
    """``template, license, words, width, marks, kind``; kind 0 is found by windows, else by single shingles of ``width`` words."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
                               for i, (name, text) in enumerate(catalogue)]))
    rows = spark.range(1).select(rows.alias("t")).select("t.template", "t.license", words_of(F.col("t.text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    rows = rows.withColumn("hashes", word_hashes(F.col("words")))
    marks = shingle_hashes(F.col("hashes"), SHINGLE)
    for width in range(1, SHINGLE):
        marks = F.when(F.col("width") == width, shingle_hashes(F.col("hashes"), width)).otherwise(marks)
    rows = rows.withColumn("marks", marks)
    return rows.withColumn("kind", F.when(F.size("marks") >= WINDOW, 0).otherwise(F.col("width")))


def template_keys(rows: DataFrame) -> DataFrame:
    """``kind, band, value`` of every indexed window, with its template and its ``offset`` in it."""
    length = F.when(F.col("kind") == 0, WINDOW).otherwise(1)
    starts = F.sequence(F.lit(0), F.size("marks") - length)
    rows = rows.select("*", F.explode(starts).alias("offset"))
    own = F.slice("marks", F.col("offset") + 1, length)
    values = F.when(F.col("kind") == 0, _values(own, WINDOW)).otherwise(own)
    return rows.select("template", "kind", "offset", F.posexplode(values).alias("band", "value"))


def found_windows(words: Column, known: dict[tuple[int, int], list[int]], reach: int) -> Column:
    """Windows of a text with a known band value: ``kind, at, from, context, bands``; ``context`` are the words around it."""
    def hit(kind: int, at: Column, bands: Column) -> Column:
        low = F.greatest(at - reach, F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), low.cast("int").alias("from"),
                        F.slice(words, low + 1, 2 * reach).alias("context"), bands.alias("bands"))

    def single(kind: int, hashes: Column) -> Column:
        places = F.filter(_starts(F.size(hashes), 1), lambda i: F.get(hashes, i).isin(known[kind, 0]))
        return F.transform(places, lambda i: hit(kind, i, F.array(F.struct(F.lit(0).alias("band"), F.get(hashes, i).alias("value")))))

    def windows(hashes: Column) -> Column:
        # MinHashes of half windows, then of each two neighbours; the last half may be shorter.
        last = F.greatest(F.ceil(F.size(hashes) / _STRIDE) - 1, F.lit(0)).cast("int")
        halves = F.transform(F.sequence(F.lit(0), last), lambda b: let(F.slice(hashes, b * _STRIDE + 1, _STRIDE), lambda h: _values(h, _STRIDE)))

        def whole(parts: Column) -> Column:
            def least(i: Column, band: int) -> Column:
                return F.least(F.get(parts, i)[band], F.get(parts, i + 1)[band])

            def found(i: Column) -> Column:
                bands = F.array(*[F.struct(F.lit(b).alias("band"), least(i, b).alias("value")) for b in range(BANDS)])
                return hit(0, i * _STRIDE, bands)

            places = F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0)))
            return F.transform(F.filter(places, lambda i: _any([least(i, b).isin(known[0, b]) for b in range(BANDS)])), found)

        return F.when(F.size(hashes) > 0, let(halves, whole)).otherwise(F.lit([]).cast(HITS))

    def full(hashes: Column) -> Column:
        lists = ([single(SHINGLE, hashes)] if (SHINGLE, 0) in known else []) + ([windows(hashes)] if (0, 0) in known else [])
        return F.concat(*lists)

    def of_words(hashes: Column) -> Column:
        def short(kind: int) -> Column:
            return let(shingle_hashes(hashes, kind), lambda h: single(kind, h))

        lists = [short(kind) for kind, _ in known if 0 < kind < SHINGLE]
        if (SHINGLE, 0) in known or (0, 0) in known:
            lists.append(let(shingle_hashes(hashes, SHINGLE), full))
        return F.concat(*lists)

    return let(word_hashes(words), of_words) if known else F.lit([]).cast(HITS)


HITS = "array<struct<kind:int,at:int,from:int,context:array<string>,bands:array<struct<band:int,value:bigint>>>>"


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan(docs: DataFrame, catalogue: Sequence[tuple[str, str]] = CATALOGUE) -> DataFrame:
    """``doc_id, license, containment, first_word``: the licenses that each whole text declares."""
    spark = docs.sparkSession
    if not catalogue:
        return docs.where(F.lit(False)).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"))
    own = templates(spark, catalogue)
    keys = template_keys(own)
    known: dict[tuple[int, int], list[int]] = {}
    # The catalogue's own band values, a fixed number.
    for row in keys.select("kind", "band", "value").distinct().collect():
        known.setdefault((row["kind"], row["band"]), []).append(row["value"])
    longest = max((len(re.findall(r"[^\W_]+", text)) for _, text in catalogue), default=1) + WINDOW
    reach = longest + max(2, longest // 4)
    found = docs.select(F.col("doc_id"), F.explode(let(words_of(docs["text"]), lambda w: found_windows(w, known, reach))).alias("hit"))
    bands = found.select("doc_id", "hit.kind", "hit.at", "hit.from", "hit.context", F.explode("hit.bands").alias("b"))
    bands = bands.select("doc_id", "kind", "at", "from", "context", "b.band", "b.value")
    indexed = keys.join(own.select("template", "license", "words", "width"), "template")
    pairs = bands.join(F.broadcast(indexed), ["kind", "band", "value"])
    # The stretch of text that the template would cover, with room for inserted words.
    room = F.greatest(F.lit(2), F.floor(F.size("words") / 4)).cast("int")
    start = F.col("at") - F.col("offset") - F.col("from")
    low = F.greatest(start - room, F.lit(0))
    stretch = F.slice("context", low + 1, start + F.size("words") + room - low)

    def contained(width: int) -> Column:
        wanted = F.array_distinct(shingles(F.col("words"), width))
        return F.size(F.array_intersect(wanted, shingles(stretch, width))) / F.size(wanted)

    containment = contained(SHINGLE)
    for width in range(1, SHINGLE):
        containment = F.when(F.col("width") == width, contained(width)).otherwise(containment)
    checked = pairs.select("doc_id", "license", (F.col("from") + start).cast("long").alias("first_word"), containment.alias("containment"))
    return (checked.where(F.col("containment") >= CONTAINMENT).groupBy("doc_id", "license")
            .agg(F.max("containment").alias("containment"), F.greatest(F.min("first_word"), F.lit(0)).alias("first_word")))
