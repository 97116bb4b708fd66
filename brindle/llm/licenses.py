"""License scans, DataFrame functions only.

Two things are found in whole texts: base phrases, where their words stand one
after another, and blocks that hold enough of a template's words. The second is
an exact set-similarity join of blocks with templates. A block of a template is
twice as many words as its size class (8, 32 or 128, the least that is no less
than its words), from every so-many-th word on, so that each passage of a
template's length is whole in one. It is found if it holds at least
``threshold`` of the template's distinct words.

The words of all templates are put in order of how many documents hold them,
rarest first, counted over the whole corpus (a row a word: some hundred). With
both sides in this order, three filters come before the words are compared, for
whole documents first and then for the blocks of those that stay:

* length: fewer than the needed number of template words are there;
* prefix: of m words of which a must be shared, the first m - a + 1 of either
  side must have one in common;
* position: after the first common word too few are left on either side.

Templates are a list in the code, so what every task holds of them is bounded;
everything about a document is computed in its row, nothing is shuffled, and no
group can be hot.

Defined cases: a null text counts as empty (no words, nothing found, score 0);
a text of any length is scanned whole; repeated rows are scanned alike and all
returned; an empty table gives no rows; columns of the input stay as they are,
and ``scan`` refuses a ``result_column`` that is there already.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hof import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices as the licences word them, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
)

THRESHOLD = 0.8
CLASSES = (8, 32, 128)

FOUND = "struct<label:string,template:int,start:int,containment:double>"
PLACE = "struct<start:int,label:string>"


def split_words(text: str) -> list[str]:
    """The words of a phrase or template."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(SEPARATORS, low) if w]


def need(m: int, threshold: float) -> int:
    """How many of ``m`` words are ``threshold`` of them."""
    return next(a for a in range(1, m + 1) if a / m >= threshold)


def size_class(n: int) -> int:
    return next(c for c in CLASSES if n <= c)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def vocabulary(phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> list[str]:
    return sorted({w for _, text in (*phrases, *templates) for w in split_words(text)})


def by_frequency(docs: DataFrame, text_column: str = "text", known: list[str] | None = None) -> list[str]:
    """The words of phrases and templates, by how many documents hold them,
    rarest first: a row a word comes back, whatever the documents."""
    known = known or vocabulary()
    held = docs.select(F.explode(F.array_intersect(F.lit(known), words_of(docs[text_column]))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _literal(words: list[str]) -> Column:
    return F.lit(words)


def _similar(held: Column, mine: list[str], least: int) -> Column:
    """Whether ``held``, template words in order, passes the three filters for
    the template of words ``mine``, in the same order."""
    m = len(mine)

    def first_common(f: Column) -> Column:
        left = F.least(F.lit(m) - F.array_position(_literal(mine), f), F.size(held) - F.array_position(held, f))
        return F.coalesce(1 + left >= least, F.lit(False))

    prefix = F.slice(held, 1, F.size(held) - least + 1)
    common = F.array_intersect(_literal(mine[: m - least + 1]), prefix)
    return F.when(F.size(held) < least, F.lit(False)).otherwise(let(F.get(common, F.lit(0)), first_common))


def _blocks(words: Column, order: list[str], size: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of the blocks of a size class: (start, template words)."""
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))
    return let(F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_intersect(_literal(order), F.slice(words, s + 1, F.lit(2 * size))).alias("held"))), body)


def _in_blocks(words: Column, held: Column, order: list[str], templates: tuple, threshold: float) -> Column:
    """All blocks that reach the threshold of a template."""
    none = F.array().cast(f"array<{FOUND}>")
    rank = {w: k for k, w in enumerate(order)}
    by_class: dict = {}
    for number, (label, text) in enumerate(templates):
        parts = split_words(text)
        mine = sorted(set(parts), key=rank.__getitem__)
        by_class.setdefault(size_class(len(parts)), []).append((number, label, mine, need(len(mine), threshold)))

    def of_template(blocks: Column, number: int, label: str, mine: list[str], least: int) -> Column:
        def shared(b: Column) -> Column:
            return F.size(F.array_intersect(_literal(mine), b["held"]))

        found = F.filter(blocks, lambda b: F.when(_similar(b["held"], mine, least), shared(b) >= least).otherwise(F.lit(False)))
        return F.transform(found, lambda b: F.struct(F.lit(label).alias("label"), F.lit(number).alias("template"), b["start"].alias("start"), (shared(b) / len(mine)).alias("containment")))

    def of_class(size: int, some: list) -> Column:
        likely = F.array(*[_similar(held, mine, least) for _, _, mine, least in some])

        def searched(tests: Column) -> Column:
            every = lambda blocks: F.concat(*[F.when(F.get(tests, F.lit(k)), of_template(blocks, *t)).otherwise(none) for k, t in enumerate(some)])
            return F.when(F.exists(tests, lambda x: x), _blocks(words, order, size, every)).otherwise(none)

        return let(likely, searched)

    return F.concat(*[of_class(size, some) for size, some in by_class.items()])


def _places(words: Column, held: Column, phrases: tuple) -> Column:
    """All places of base phrases, in order."""
    none = F.array().cast(f"array<{PLACE}>")

    def of_phrase(label: str, parts: list[str]) -> Column:
        def stands(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                same = same & (F.get(words, i + k) == w)
            return same

        there = F.size(F.array_intersect(_literal(sorted(set(parts))), held)) == len(set(parts))
        at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
        return F.when(there & (F.size(words) >= len(parts)), F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(none)

    return F.array_sort(F.concat(*[of_phrase(label, split_words(text)) for label, text in phrases]))


def found_in(text: Column, order: list[str], phrases: tuple = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """struct of ``n_words``, ``places`` of base phrases (start word, label)
    and ``blocks`` (label, number of the template, start word, containment)."""

    def of_words(w: Column) -> Column:
        return let(
            F.array_intersect(_literal(order), w),
            lambda held: F.struct(F.size(w).cast("long").alias("n_words"), _places(w, held, phrases).alias("places"), _in_blocks(w, held, order, templates, threshold).alias("blocks")),
        )

    return let(words_of(text), of_words)


def labels(result: Column) -> Column:
    """The distinct labels of places and blocks, in order."""
    return F.array_sort(F.array_distinct(F.concat(result["places"]["label"], result["blocks"]["label"])))


def score(result: Column) -> Column:
    """The greatest containment found; 1 where a base phrase stands."""
    return F.when(F.size(result["places"]) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(result["blocks"]["containment"]), F.lit(0.0)))


def scan(docs: DataFrame, text_column: str = "text", result_column: str = "licenses", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the struct of ``found_in`` as ``result_column``."""
    if result_column in docs.columns:
        raise ValueError(f"the documents have a column {result_column} already")
    order = by_frequency(docs, text_column, vocabulary(phrases, templates))
    return docs.withColumn(result_column, found_in(docs[text_column], order, phrases, templates, threshold))
