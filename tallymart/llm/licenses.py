"""License scan: exact phrases, and blocks of text that contain the words of a license notice.

The second part is a set-similarity join of text blocks with templates. A template matches a block if at
least ``THRESHOLD`` of its distinct words occur in it. A template of w words is looked for in blocks of twice
the next power of two s >= w, one every s words, so any stretch of s words lies inside a block. Template
words are ordered by how often they occur in the whole corpus, rare ones first. To share alpha of m
words, a block and a template must share one of the template's first m - alpha + 1 words (prefix filter),
the block must have alpha template words (length filter), and behind the shared word both must have
enough left (positional filter). What passes is verified on the full sets, so the result is exact.

All steps are DataFrame operations on built-in functions. The templates are fixed text, so what is
broadcast and the order that the driver sees do not grow with the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.session import materialize

# Phrases and labels of the contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Standard notices by which licenses are stated, one label per license.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
THRESHOLD = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with single blanks between them, A-Z lower-cased."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAP, " "))


def plain_words(text: str) -> list[str]:
    """The words of a phrase or template, by the same rule."""
    return re.sub(_GAP, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(padded: Column, n_words: Column, phrase: str) -> dict[str, Column]:
    """How often a phrase occurs among the words of ``padded`` (overlaps count), first and last place.

    The text is cut in front of each occurrence. What comes before the first has one blank per word, and
    what follows the last cut has one per word and one more.
    """
    words = f" {' '.join(plain_words(phrase))} "
    pieces = F.split(padded, f"(?={words})", -1)
    has = F.contains(padded, F.lit(words))
    return {
        "n": F.when(has, F.size(pieces) - 1).otherwise(0).cast("long"),
        "first": F.when(has, _blanks(F.get(pieces, F.lit(0)))).cast("long"),
        "last": F.when(has, n_words + 1 - _blanks(F.element_at(pieces, -1))).cast("long"),
    }


class _Template:
    def __init__(self, label: str, text: str, threshold: float):
        words = plain_words(text)
        self.label = label
        self.words = sorted(set(words))
        self.size = 1 << (len(words) - 1).bit_length()
        self.least = math.ceil(threshold * len(self.words) - 1e-9)

    def ordered(self, place: Mapping[str, int]) -> list[str]:
        return sorted(self.words, key=place.__getitem__)

    def prefix(self, place: Mapping[str, int]) -> list[str]:
        """The rarest words, of which every block that matches holds at least one."""
        return self.ordered(place)[: len(self.words) - self.least + 1]


def _prefix_words(templates: Sequence[_Template], place: Mapping[str, int]) -> list[str]:
    return sorted({word for t in templates for word in t.prefix(place)})


def word_order(texts: DataFrame, words: Sequence[str]) -> list[str]:
    """``words`` by the number of their occurrences in all texts (column ``spaced``), rare ones first."""
    spark = texts.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))
    every = texts.select(F.explode(F.split("spaced", " ")).alias("word"))
    counted = every.join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counted.collect()}
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _blocks(rows: DataFrame, templates: list[_Template], order: list[str]) -> DataFrame:
    """row_id, size, at, and the template words of every block that has a prefix word, rare ones first."""
    place = {w: i for i, w in enumerate(order)}
    each = []
    for size in sorted({t.size for t in templates}):
        prefix = _literal(_prefix_words([t for t in templates if t.size == size], place))
        # The last block is the one that reaches the end of the text.
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - F.lit(2 * size)) / size), F.lit(0)).cast("int"))
        cut = F.transform(
            starts, lambda i: F.struct(F.lit(size).alias("size"), (i * size).alias("at"), F.slice("words", i * size + 1, F.lit(2 * size)).alias("words"))
        )
        each.append(F.filter(cut, lambda b: F.arrays_overlap(b["words"], prefix)))
    block = rows.select("row_id", F.explode(F.concat(*each)).alias("b"))
    held = F.array_intersect(_literal(order), F.col("b.words"))
    return block.select("row_id", "b.size", "b.at", held.alias("held"))


def _match(blocks: DataFrame, templates: list[_Template], order: list[str]) -> DataFrame:
    """row_id, label, at, size and containment of every block and template over the threshold."""
    place = {w: i for i, w in enumerate(order)}
    entries = [
        F.struct(
            F.lit(t.size).alias("size"), F.lit(word).alias("word"), F.lit(position).alias("template_at"), F.lit(t.label).alias("label"),
            F.lit(t.least).alias("least"), _literal(t.ordered(place)).alias("wanted"),
        )
        for t in templates
        for position, word in enumerate(t.prefix(place))
    ]
    index = blocks.sparkSession.range(1).select(F.inline(F.array(*entries)))
    spread = blocks.select("row_id", "size", "at", "held", F.posexplode("held").alias("block_at", "word"))
    met = spread.join(F.broadcast(index), ["size", "word"])
    left = F.least(F.size("held") - F.col("block_at"), F.size("wanted") - F.col("template_at"))
    passed = met.where(
        (F.size("held") >= F.col("least"))
        & (F.col("block_at") <= F.size("held") - F.col("least"))
        & (left >= F.col("least"))
    )
    shared = F.size(F.array_intersect("held", "wanted"))
    return passed.where(shared >= F.col("least")).select(
        "row_id", "label", "at", "size", (shared / F.size("wanted")).alias("containment")
    )


def _prepared(
    docs: DataFrame, id_col: str, text_col: str, phrases: Mapping[str, str], templates: list[_Template]
) -> tuple[DataFrame, list[str]]:
    """One written row per document with its phrase places, and its words if a template may match."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), spaced(text).alias("spaced"))
    order = word_order(texts, sorted({w for t in templates for w in t.words}))
    place = {w: i for i, w in enumerate(order)}
    prefix = _literal(_prefix_words(templates, place))

    n_words = F.when(F.col("spaced") == "", 0).otherwise(_blanks(F.col("spaced")) + 1).cast("long")
    padded = F.concat(F.lit("| "), F.col("spaced"), F.lit(" "))
    found = {phrase: _places(padded, F.col("n_words"), phrase) for phrase in phrases}
    nothing = F.lit(None).cast("long")
    counted = texts.withColumn("n_words", n_words).select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "n_words",
        sum((p["n"] for p in found.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[p["first"] for p in found.values()], nothing, nothing).alias("first_word"),
        F.greatest(*[p["last"] for p in found.values()], nothing, nothing).alias("last_word"),
        F.array_compact(F.array(*[F.when(p["n"] > 0, F.lit(phrases[q])) for q, p in found.items()]).cast("array<string>")).alias("base"),
        F.when(F.arrays_overlap(F.split("spaced", " "), prefix), F.split("spaced", " ")).alias("words"),
    )
    return materialize(counted, "license_rows"), order


def _templates(templates: Mapping[str, Sequence[str]], threshold: float) -> list[_Template]:
    return [_Template(label, text, threshold) for label, texts in templates.items() for text in texts]


def license_blocks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, label, first_word, n_words and containment of every block that meets a template.

    Blocks of one size overlap, so one notice may be in two; a notice met by two templates of its label is
    in two rows. Rows of documents without blocks are left out.
    """
    kinds = _templates(templates, threshold)
    rows, order = _prepared(docs, id_col, text_col, {}, kinds)
    met = _match(_blocks(rows.where("words is not null"), kinds, order), kinds, order).distinct()
    named = met.join(rows.select("row_id", "doc_id", F.col("n_words").alias("of")), "row_id")
    length = F.least(F.lit(2) * F.col("size"), F.col("of") - F.col("at")).cast("long")
    return named.select("doc_id", "label", F.col("at").cast("long").alias("first_word"), length.alias("n_words"), "containment")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``n_base`` counts the places of all phrases, overlaps included; the first and last are word numbers from
    0, NULL without any. ``labels`` are those of the phrases and of the templates met, sorted; without any the
    text is empty. ``score`` is 1 where a phrase stands, else the highest share of a met template's words in a
    block, else 0. NULL texts count as empty, ids may be NULL or repeat, and other columns are not read. An
    empty table gives no rows.
    """
    kinds = _templates(templates, threshold)
    rows, order = _prepared(docs, id_col, text_col, phrases, kinds)
    met = _match(_blocks(rows.where("words is not null"), kinds, order), kinds, order)
    per_row = met.groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = rows.drop("words").join(per_row, "row_id", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", more)).alias("labels"), score.alias("score"),
    )
