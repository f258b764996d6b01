"""Licence scan: diagonal voting of word k-grams against licence templates.

The rolling 3-grams of a text's words are joined to the places of that 3-gram in the templates.  A hit votes for
its diagonal, place in the text less place in the template; diagonals that lie within
``SLACK`` of the next are one match with words inserted or left out.  The span from first to
last hit is verified by the share of the template's 3-grams that it holds, and
gives a label from ``COVER`` on.

Base phrases are counted beside that in the same projection; the phrases' words
stand in a row wherever they occur.

Distribution: one scan and one splitting of the texts.  A 3-gram whose hash is not among those of the templates
can't join and is left out in that projection; what is left is written with the base columns, one narrow row for each text,
under a row number of its own.  The Spark join then goes by hash and by the 3-gram itself.  The templates
are a constant of this module, so the join side that is broadcast never grows.  Only rows with
hits reach a shuffle, by row number, so no key is hot.

Values: null text is empty: no words, counts 0, null first and last word, empty labels,
score 0; repeated rows and rows that share a doc_id, or have none, are judged each alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.llm.shared import lasting, small, written

#: Phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings and notices of public licences, as they ask to be quoted.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "proprietary": ["No part of this publication may be reproduced, distributed, or transmitted in any form"],
}

K = 3
#: Widest step between diagonals of one match, in words.
SLACK = 3
#: Least share of a template's 3-grams in a verified span.
COVER = 0.8

#: What parts words: all of ASCII but digits and letters.
PART = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
NO_PLACES = "CAST(array() AS ARRAY<INT>)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "coalesce(text, '')") -> str:
    """SQL: the words of a text, A-Z in lower case.

    The case of the few words that matter is all that counts, so whole texts are not
    translated letter by letter: ``lower`` is used where it can't change ASCII matches.
    """
    return f"filter(split({text}, '{PART}', -1), x -> x <> '')"


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def template_grams(templates: dict[str, list[str]]) -> list[tuple]:
    """(label, template number, k-grams in it, place, gram) of all templates."""
    import re

    out = []
    number = 0
    for label, texts in templates.items():
        for text in texts:
            w = [x for x in re.split(r"[^0-9a-z]+", text.lower()) if x]
            n = len(w) - K + 1
            out += [(label, number, n, i, " ".join(w[i : i + K])) for i in range(n)]
            number += 1
    return out


def _places() -> str:
    """SQL: for each base phrase an array of its places among the words ``w``."""
    places = []
    for phrase in PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"{_low(f'w[i + {k}]')} = '{p}'" for k, p in enumerate(parts))
        places.append(f"if(size(w) < {len(parts)}, {NO_PLACES}, filter(sequence(0, size(w) - {len(parts)}), i -> {same}))")
    some = "(?i)" + "|".join(PART.join(p.split()) for p in PHRASES)
    return f"if(coalesce(text, '') rlike '{some}', array({', '.join(places)}), array({', '.join([NO_PLACES] * len(PHRASES))}))"


def _hits(templates: dict[str, list[str]]) -> str:
    """SQL: the rolling 3-grams (place, gram) of the words ``w`` whose hash is that of a template's."""
    grams = sorted({g[4] for g in template_grams(templates)})
    first = ", ".join(f"'{x}'" for x in sorted({g.split(" ")[0] for g in grams}))
    gram = "concat_ws(' ', " + ", ".join(_low(f"w[i + {k}]") for k in range(K)) + ")"
    known = ", ".join(f"xxhash64('{g}')" for g in grams)
    at = f"if(size(w) < {K}, {NO_PLACES}, filter(sequence(0, size(w) - {K}), i -> lower(w[i]) IN ({first}) AND xxhash64({gram}) IN ({known})))"
    return f"transform({at}, i -> named_struct('i', i, 'gram', {gram}))"


def gathered(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, row, n_words, places, hits) of each row of ``docs``, written; ``places`` by base phrase."""
    body = f"named_struct('n', CAST(size(w) AS BIGINT), 'p', {_places()}, 'h', {_hits(templates)})"
    one = docs.select("doc_id", F.expr(f"element_at(transform(array({words()}), w -> {body}), 1)").alias("b"))
    return written(one.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("b.n").alias("n_words"), F.col("b.p").alias("places"), F.col("b.h").alias("hits")))


def matched(rows: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(row, label, first_word, last_word, cover): verified licence spans of :func:`gathered` rows."""
    table = small(rows.sparkSession, template_grams(templates), "label string, template int, of int, at int, gram string").withColumn("hash", F.xxhash64("gram"))
    grams = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("g")).select("row", "g.i", "g.gram", F.xxhash64("g.gram").alias("hash"))
    hits = grams.join(F.broadcast(table), ["hash", "gram"])
    diagonals = hits.groupBy("row", "label", "template", "of", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(0))
    matches = diagonals.withColumn("new", near).withColumn("match", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = matches.groupBy("row", "label", "template", "of", "match").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"), F.min("lo").alias("first_word"), (F.max("hi") + K - 1).alias("last_word")
    )
    cover = F.col("held") / F.col("of")
    return merged.where(cover >= COVER).select("row", "label", "first_word", "last_word", cover.alias("cover"))


def spans(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, row, label, first_word, last_word, cover): verified licence spans of ``docs``;
    ``row`` tells rows of one doc_id apart."""
    rows = gathered(docs, templates)
    return rows.select("doc_id", "row").join(matched(rows, templates), "row").select("doc_id", "row", "label", "first_word", "last_word", "cover")


def scanned(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of ``docs``."""

    def build() -> DataFrame:
        rows = gathered(docs.select("doc_id", "text"), templates)
        found = matched(rows, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
        base = F.filter(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
        both = rows.withColumn("base", base).withColumn("all", F.flatten("places")).join(found, "row", "left")
        none: Column = F.array().cast("array<string>")
        return both.select(
            "doc_id",
            "n_words",
            F.size("all").cast("long").alias("n_base"),
            F.array_min("all").cast("long").alias("first_word"),
            F.array_max("all").cast("long").alias("last_word"),
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
            F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        )

    return lasting(build)


def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
