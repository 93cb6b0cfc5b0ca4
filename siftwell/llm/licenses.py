"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, twice as long as a template (rounded up to a power of two) and overlapping by half, so
that a passage of a template's length lies in one block. A block meets a template if it holds at least ``THRESHOLD`` of
the template's different tokens. Tokens are put in one global order, rarest first, by counts over all documents. Then

* prefix filter: a block that meets a template of n tokens holds one of its n - ceil(THRESHOLD * n) + 1 rarest tokens,
  so only places of those tokens make candidates (an equi-join on the token);
* length filter: the block has at least ceil(THRESHOLD * n) different words;
* positional filter: from the shared token on in the global order, the block still has that many template tokens;
* what is left is compared on full sets.

The template table is small by its nature (``MAX_POSTINGS`` is checked before it is broadcast; a larger one is joined by
a shuffle). Texts aren't shuffled: candidates carry their own block only.

Defined results: a null text counts as empty; a text without words has no labels and a score of 0; repeated rows and
ties are judged row by row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import ascii_lower, let, materialise

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
MAX_POSTINGS = 100_000
#: So many rows (16 MB of hashes) may be broadcast to prune a scan; beyond, the scan is joined by a shuffle.
BROADCAST_ROWS = 2_000_000

# Phrases of the contract and their labels.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Passages of well-known license texts and notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
]


def license_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``template, label, tokens`` (different ones) ``, window``."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("words", license_words(F.col("text")))
    window = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.size("words")))).cast("int")
    return rows.select("template", "label", F.array_distinct("words").alias("tokens"), window.alias("window"))


def token_order(held: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``token, rank``: the templates' tokens by the number of rows that hold them, rarest first.

    ``held`` has ``tokens``, those of the vocabulary that the row holds. One row per token and task is shuffled.
    """
    counts = dict(held.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())  # at most one row per template token
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    return held.sparkSession.createDataFrame(list(zip(order, range(len(order)), strict=True)), "token string, rank int")


def postings(templates: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """Prefix tokens: ``token, rank, template, label, needed, window, tokens, ranks``."""
    ranked = templates.select("*", F.explode("tokens").alias("token")).join(order, "token")
    sets = ranked.groupBy("template", "label", "tokens", "window").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("ordered"))
    sets = sets.withColumn("needed", F.ceil(F.size("tokens") * F.lit(threshold) - 1e-9).cast("int"))
    prefix = sets.withColumn("p", F.explode(F.slice("ordered", F.lit(1), F.size("tokens") - F.col("needed") + 1)))
    return prefix.select(F.col("p.token").alias("token"), F.col("p.rank").alias("rank"), "template", "label", "needed", "window", "tokens", F.col("ordered").alias("ranks"))


def vocabulary_of(templates: DataFrame) -> list[str]:
    """The templates' tokens, as many as the template table has."""
    return [r["token"] for r in templates.select(F.explode("tokens").alias("token")).distinct().sort("token").collect()]


def _tokens_held(words: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, vocabulary)).cast("array<string>"))


def blocks_met(docs: DataFrame, posts: DataFrame, text_col: str) -> DataFrame:
    """Every block of ``docs`` that meets a template, by the templates' prefix tokens ``posts``.

    Blocks around prefix tokens are cut out of the text, each as its different words, before anything is joined.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rare = [r["token"] for r in posts.select("token").distinct().sort("token").collect()]
    windows = [r["window"] for r in posts.select("window").distinct().sort("window").collect()]
    if posts.count() <= MAX_POSTINGS:
        posts = F.broadcast(posts)

    def cut(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), i)), lambda p: p.isNotNull())

        def blocks(at: Column, window: int) -> Column:
            half = window // 2
            numbers = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.greatest(F.floor(p / half) - 1, F.lit(0)), F.floor(p / half)))))
            one = lambda b: F.struct(F.lit(window).alias("window"), (b * half).cast("int").alias("first_word"), F.array_distinct(F.slice(words, (b * half).cast("int") + 1, F.lit(window))).alias("held"))
            return F.transform(numbers, one)

        return let(places, lambda at: F.flatten(F.array(*(blocks(at, w) for w in windows))))

    if not windows:
        windows, rare = [2], [""]  # no template: no block
    near = docs.select(*others, F.inline(let(license_words(F.col(text_col)), cut)))
    near = near.withColumn("token", F.explode(_tokens_held(F.col("held"), rare))).join(posts, ["token", "window"]).filter(F.size("held") >= F.col("needed"))
    rest = F.filter("ranks", lambda r: r["rank"] >= F.col("rank"))
    near = near.filter(F.size(F.array_intersect(F.col("held"), F.transform(rest, lambda r: r["token"]))) >= F.col("needed") - (F.size("ranks") - F.size(rest)))
    met = near.withColumn("both", F.size(F.array_intersect("held", "tokens"))).filter(F.col("both") >= F.col("needed"))
    return met.select(*others, "template", "label", "first_word", (F.col("both") / F.size("tokens")).alias("containment")).distinct()


def matching_blocks(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Every block that meets a template: the columns of ``docs`` but the text, and ``template, label, first_word, containment``."""
    vocabulary = vocabulary_of(templates)
    held = docs.select(_tokens_held(license_words(F.col(text_col)), vocabulary).alias("tokens"))
    return blocks_met(docs, postings(templates, token_order(held, vocabulary), threshold), text_col)


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")

    def starts(w: Column, i: Column) -> Column:
        same = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return F.when(same, i)

    return F.filter(F.transform(words, starts), lambda p: p.isNotNull())


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    templates = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    vocabulary = vocabulary_of(templates)

    def described(w: Column) -> Column:
        places = F.array(*(F.struct(F.lit(label).alias("label"), _phrase_places(w, phrase).alias("at")) for label, phrase in BASE_PHRASES.items()))
        any_key = F.arrays_overlap(w, F.array(F.lit("license"), F.lit("cc")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(any_key, places).alias("places"), _tokens_held(w, vocabulary).alias("tokens"))

    # The one pass over all texts; only those with a prefix token are read once more.
    rows = slim.select("doc_id", "row", F.inline(F.array(let(license_words(F.col("text")), described))))
    rows = materialise(rows.select("doc_id", "row", "n_words", "places", "tokens"), "license-words")
    posts = materialise(postings(templates, token_order(rows, vocabulary), threshold), "license-postings")
    rare = [r["token"] for r in posts.select("token").distinct().collect()]  # tokens of the template table
    near = materialise(rows.filter(F.size(_tokens_held(F.col("tokens"), rare)) > 0).select(F.col("row").alias("_row")).distinct(), "license-rows")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    found = blocks_met(slim.join(near, F.col("row") == F.col("_row"), "left_semi").select("row", "text"), posts, "text")
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))

    places = F.filter(F.coalesce(F.col("places"), F.array().cast("array<struct<label:string,at:array<int>>>")), lambda p: F.size(p["at"]) > 0)
    rows = rows.select("doc_id", "row", "n_words", places.alias("places")).join(found, "row", "left")
    every = F.flatten(F.transform("places", lambda p: p["at"]))
    own = F.transform("places", lambda p: p["label"])
    return rows.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
