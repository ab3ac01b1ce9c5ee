"""License scans by diagonal voting. Native: DataFrame functions only.

Texts and license templates are cut into words and hashed by rolling grams of
`GRAM` words. Document grams are joined with template positions; a hit votes
for the diagonal (document place minus template place). A phrase stands
wherever all of its grams vote for one diagonal. For whole license texts,
diagonals that lie near each other are merged, so a few words put in or left out
do not split a match. A merged band is `2 * SPREAD` diagonals wide, and bands lie
`SPREAD` apart, so any diagonals at most `SPREAD` apart are in one band, and no
number of hits around a match widens it. A band is verified word by word: the
longest row of template grams that stand in the text in the template's order
must hold a share of them that reaches a threshold, and is the match.

Hits are gathered by the text's key, not by row, and are distinct places: any
number of copies of a text, a third of all rows say, adds nothing to them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .job import anew, cut, let
from .textkit import text_key

GRAM = 2
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings of well-known public license texts and notices, for the labels that the method adds.
TEMPLATES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "public-domain": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
SPREAD, LEAST = 8, 0.6
#: Of all templates: about 2 MB of grams, a proven bound for their broadcast.
MOST_WORDS = 50_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for a null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, BETWEEN), "")


def grams(w: Column) -> Column:
    """Hash of each GRAM words in a row."""

    def roll(w: Column) -> Column:
        n = F.size(w) - GRAM + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)])))

    return let(w, roll)


def template_positions(spark: SparkSession, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """name, label, is_phrase, n_grams, place, gram: a row for each gram of the phrases and of templates (label: text).

    Templates are held by the driver and meet every text, so their words are at
    most MOST_WORDS in all; more are an error. One of fewer words than a gram is never found.
    """
    if (n := sum(len(t.split()) for t in templates.values())) > MOST_WORDS:
        raise ValueError(f"templates of {n} words; {MOST_WORDS} are the most")
    rows = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for label, t in templates.items()]
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, text string, label string, is_phrase boolean")
    each = base.withColumn("grams", grams(words(F.col("text"))))
    return each.select("template", "label", "is_phrase", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("place", "gram"))


def matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Spans of phrases and license texts: key, label, is_phrase, first, last (words), share of the template's grams.

    key is text_key() of the text. A phrase's span is exact. Of a license text,
    votes are merged over diagonals at most SPREAD apart, so it may have that
    many words put in or left out. Null and empty texts have no spans; equal
    texts have one key and are one text.
    """
    known = template_positions(docs.sparkSession, templates)
    each = docs.select(text_key(F.col("text")).alias("key"), F.posexplode(grams(words(F.col("text")))).alias("at", "gram"))
    votes = each.join(F.broadcast(known), "gram").select("key", "template", "label", "is_phrase", "n_grams", "place", "at").distinct()
    diagonals = cut(
        votes.groupBy("key", "template", "label", "is_phrase", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
            F.count("*").alias("n"), F.collect_list("at").alias("ats"), F.min("at").alias("first"), F.max("at").alias("last")
        )
    )  # read twice below; without the cut, all texts would be scanned twice
    phrases = diagonals.where("is_phrase and n = n_grams").select("key", "label", "is_phrase", "first", (F.col("last") + GRAM - 1).alias("last"), F.lit(1.0).alias("share"))
    band = F.floor(F.col("diagonal") / SPREAD).cast("int")
    hits = F.transform("ats", lambda at: F.struct(at.alias("at"), (F.col("diagonal") - at).alias("minus_place")))
    bands = (
        diagonals.where("not is_phrase").select("key", "label", "is_phrase", "n_grams", "template", hits.alias("hits"), F.explode(F.array(band - 1, band)).alias("band"))
        .groupBy("key", "label", "is_phrase", "n_grams", "template", "band").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    )
    places = F.array_distinct(F.transform("hits", lambda h: h["minus_place"]))
    verified = bands.where(F.size(places) >= LEAST * F.col("n_grams")).withColumn("match", in_order("hits", "n_grams"))
    verified = verified.withColumn("share", F.col("match.held") / F.col("n_grams")).where(F.col("share") >= LEAST)
    texts = verified.select("key", "label", "is_phrase", F.col("match.first").alias("first"), (F.col("match.last") + GRAM - 1).alias("last"), "share").distinct()
    return phrases.unionByName(texts)


def in_order(hits: str, n_grams: str) -> Column:
    """Longest row of hits whose places in text and template both ascend: held, first and last (in the text).

    hits: (at, minus_place), sorted, so that hits of one word of the text come
    with the template's later places first and cannot follow each other. The
    state has, for each place of the template, the best row that ends there or
    before; of rows of one length, the one that starts last.
    """
    state = lambda held, first, last: F.struct(held.alias("held"), first.alias("first"), last.alias("last"))
    none = state(F.lit(0), F.lit(0), F.lit(0))

    def take(rows: Column, hit: Column) -> Column:
        place = -hit["minus_place"]

        def put(row: Column) -> Column:
            return F.transform(rows, lambda old, i: F.when(i > place, F.greatest(old, row)).otherwise(old))

        before = F.element_at(rows, place + 1)  # of places below this one
        return let(state(before["held"] + 1, F.when(before["held"] == 0, hit["at"]).otherwise(before["first"]), hit["at"]), put)

    return F.element_at(F.aggregate(hits, F.array_repeat(none, F.col(n_grams) + 1), take), -1)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs.

    score: the largest share of a template that was found, 1 for a phrase.
    Null and empty texts have no words and no labels; repeated rows get equal
    results; documents without a hit have score 0 and null places. templates:
    label and text of each license to look for beside the phrases.
    """
    by_text = (
        matches(docs, templates)
        .groupBy("key")
        .agg(
            F.sum(F.col("is_phrase").cast("long")).alias("n_base"),
            F.min(F.when(F.col("is_phrase"), F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("is_phrase"), F.col("first"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_phrase"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").cast("double").alias("score"),
        )
    )
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(anew(by_text, "key"), "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
