"""License scan: phrases in order, and text blocks that contain enough of a license template.

The method is an exact set-similarity join of templates and text blocks. A block is a
window of consecutive words, across line ends, ``1 / threshold`` times as long as the
template. The words of the templates are ordered by how many documents have them, rarest
first. A window that shares the fraction ``threshold`` of a template's words must share one
of the template's first words in that order (prefix filter), so only the surroundings of
such words are looked at; they must have enough template words (length filter), and enough
words must be left behind the prefix word on both sides (positional filter). In what passes
every window around the prefix word is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, literal_list, words

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and openings of common licenses, in words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("proprietary", "all rights reserved"),
)
THRESHOLD = 0.8


def _places(phrase: str) -> Column:
    """Start of every place where the words of ``phrase`` stand one after another in ``w``."""
    parts = phrase.split()
    none = F.array().cast("array<int>")

    def here(i):
        return F.array_join(F.slice("w", i + 1, len(parts)), " ") == phrase

    rarest = F.array_contains("w", parts[0]) & F.array_contains("w", parts[-1])
    starts = F.when(F.size("w") >= len(parts), F.sequence(F.lit(0), F.size("w") - len(parts))).otherwise(none)
    first = F.filter(starts, lambda i: F.get("w", i) == parts[0])
    return F.when(rarest, F.filter(first, here)).otherwise(none)


def _ordered_vocabulary(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> list[str]:
    """The templates' words, rarest first by documents that have them; no more rows than words come back."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    shared = F.array_intersect(words(ascii_lower(F.col(text))), F.expr(literal_list(vocabulary)))
    counts = dict(docs.select(F.explode(shared).alias("word")).groupBy("word").count().collect())
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def window_size(template: str, threshold: float = THRESHOLD) -> int:
    """Words of the windows in which a template is sought."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks), a row per row of ``docs``.

    ``blocks`` lists (label, start, containment) of the best window, and of those the first, for each template
    that some window contains; ``start`` counts words from 0. ``score`` is 1 with a phrase, else the largest
    containment, else 0. Null and empty texts have no words, no labels and score 0. Repeated rows are scanned
    each; other columns are not carried.
    """
    order = _ordered_vocabulary(docs, text, templates)
    rank = {w: i + 1 for i, w in enumerate(order)}
    index, prefix = [], set()
    for no, (label, template) in enumerate(templates):
        own = sorted({rank[w] for w in template.split()})
        need = math.ceil(threshold * len(own) - 1e-9)
        for p, token in enumerate(own[:len(own) - need + 1]):
            index.append((token, no, label, p, need, own, window_size(template, threshold)))
            prefix.add(token)
    reach = max((row[-1] for row in index), default=1)
    index = docs.sparkSession.createDataFrame(index, "token int, template int, label string, p int, need int, own array<int>, size int")

    starters = F.expr(literal_list([w for w in order if rank[w] in prefix]))
    vocabulary = F.expr(f"map_from_arrays({literal_list(order)}, cast(sequence(1, {len(order)}) as array<int>))") if order else None
    places = {phrase: _places(phrase) for phrase in phrases}
    all_places = F.flatten(F.array(*places.values()))
    base = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(p) > 0, phrases[k]) for k, p in places.items()]), lambda x: x.isNotNull())))
    # The words around each prefix word: as far as a window that holds it can reach.
    none = F.array().cast("array<int>")
    marked = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(starters, x), i)), lambda i: i.isNotNull())
    near = F.transform(F.when(F.arrays_overlap("w", starters), marked).otherwise(none), lambda i: F.struct(
        i.alias("at"), F.greatest(i - reach + 1, F.lit(0)).alias("first"),
        F.slice("w", F.greatest(i - reach + 1, F.lit(0)) + 1, F.lit(2 * reach - 1)).alias("words")))
    rows = (docs.select(F.col(doc_id).alias("doc_id"), words(ascii_lower(F.col(text))).alias("w"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", near.alias("near"),
                    F.size("w").cast("bigint").alias("n_words"), all_places.alias("places"), base.alias("base"))
            .select("row", "doc_id", "near", "n_words", F.size("places").cast("bigint").alias("n_base"),
                    *[f("places").cast("bigint").alias(n) for f, n in ((F.array_min, "first_word"), (F.array_max, "last_word"))], "base"))
    keep = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    around = rows.select(*keep, F.explode_outer("near").alias("n")).select(
        *keep, F.col("n.first").alias("first"), (F.col("n.at") - F.col("n.first")).alias("at"),
        F.transform("n.words", lambda x: F.coalesce(F.try_element_at(vocabulary, x), F.lit(0))).alias("ranks") if order else none.alias("ranks"))
    around = around.withColumn("token", F.get("ranks", F.col("at")))
    # At most one row for each prefix word of each template, so the index is bounded by the parameter.
    shared = F.array_sort(F.array_intersect("ranks", "own"))
    behind = F.least(F.size("own") - F.col("p") - 1, F.size(shared) - F.array_position(shared, F.col("token")))
    starts = F.filter(F.sequence(F.greatest(F.col("at") - F.col("size") + 1, F.lit(0)), F.col("at")),
                      lambda i: F.array_contains("own", F.get("ranks", i)))
    best = F.array_max(F.transform(starts, lambda i: F.struct(
        F.size(F.array_intersect(F.slice("ranks", i + 1, F.col("size")), "own")).alias("n"), (-i).alias("back"))))
    met = around.join(F.broadcast(index), "token", "left").withColumn(
        "best", F.when((F.size(shared) >= F.col("need")) & (behind + 1 >= F.col("need")), best))
    hit = F.when(F.col("best.n") >= F.col("need"), F.struct(
        F.col("best.n").alias("n"), (-(F.col("first") - F.col("best.back"))).alias("back"), "label", F.size("own").alias("of")))
    by_template = met.groupBy(*keep, "template").agg(F.max(hit).alias("hit"))
    block = F.when(F.col("hit").isNotNull(), F.struct(
        F.col("hit.label").alias("label"), (-F.col("hit.back")).alias("start"), (F.col("hit.n") / F.col("hit.of")).alias("containment")))
    by_row = by_template.groupBy(*keep).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    labels = F.array_sort(F.array_union("base", F.transform("blocks", lambda b: b["label"])))
    top = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return by_row.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(top, F.lit(0.0))).alias("score"), "blocks")
