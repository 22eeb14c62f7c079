"""License scans by diagonal voting. DataFrame functions only.

Words are runs of ASCII digits, letters (lower-cased) and non-ASCII characters. Every
rolling 2-gram of a text is hashed and joined to the places where the templates
have it; a hit at word i of the text and word j of the template votes for the
diagonal i - j. Votes are counted by diagonal; diagonals that lie within
an eighth of the template's length of each other are merged (words inserted or
left out shift the rest); a merged span is verified by the share of the
template's 2-grams that it holds.

Base phrases are templates too; only diagonals with every vote, that is
places where all words stand consecutively, count for them.

The templates are this module's own short table; they are broadcast when
below MAX_TEMPLATE_GRAMS, else joined by shuffle.

Defined results: null and empty texts have no words, no labels and score 0;
every row is scanned by itself, so null or repeated ids do not matter; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TEMPLATE_GRAMS, COVERAGE = 200_000, 0.8

# Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Well-known notices and their labels.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONE, _SOME = -1, -2  # hashes of the marks that carry a text's number of words through the join


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words)."""
    all_ = [(label, True, phrase) for phrase, label in BASE.items()] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, base, template_words(text)) for i, (label, base, text) in enumerate(all_)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def grams(ws: Column) -> Column:
    """Hashes of the 2-grams, then one mark at the place of the last word that tells the number of words."""
    def of(ws: Column) -> Column:
        n = F.size(ws)
        pairs = F.zip_with(F.slice(ws, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.concat(pairs, F.array(F.when(n == 0, F.lit(_NONE).cast("bigint")).otherwise(F.lit(_SOME).cast("bigint"))))

    return F.get(F.transform(F.array(ws), of), F.lit(0))  # the words are made once, however often they are used


def template_table(spark, rows: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """h, template, at, n_grams, slack of every 2-gram of the templates, and of the marks (template -1)."""
    flat = [(i, at, a, b, len(ws) - 1, len(ws) // 8) for i, _, _, ws in rows for at, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
    df = spark.createDataFrame(flat, "template int, at int, a string, b string, n_grams int, slack int").select(F.xxhash64("a", "b").alias("h"), "template", "at", "n_grams", "slack")
    return df.union(spark.createDataFrame([(_NONE, -1, 0, 0, 0), (_SOME, -1, 0, 0, 0)], "h bigint, template int, at int, n_grams int, slack int"))


def spans(docs: DataFrame, rows: list[tuple[int, str, bool, list[str]]] | None = None) -> DataFrame:
    """row, doc_id, template, start, diagonals, votes, found, n_grams of every merged span, and one line of template -1 for each text.

    found counts the distinct 2-grams of the template in the span; for the
    line of template -1, start is the number of words.
    """
    spark = docs.sparkSession
    rows = templates() if rows is None else rows
    each = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), grams(words(F.col("text"))).alias("grams"))
    each = each.select("doc_id", "row", F.posexplode("grams").alias("pos", "h"))
    table = template_table(spark, rows)
    small = sum(len(ws) for *_, ws in rows) <= MAX_TEMPLATE_GRAMS
    hits = each.join(F.broadcast(table) if small else table, "h").select("row", "doc_id", "template", "n_grams", "slack", "at", F.when(F.col("h") == _NONE, 0).when(F.col("h") == _SOME, F.col("pos") + 1).otherwise(F.col("pos") - F.col("at")).alias("diagonal"))
    votes = hits.repartition("row").groupBy("row", "doc_id", "template", "n_grams", "slack", "diagonal").agg(F.collect_set("at").alias("ats"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= F.col("slack"), 0).otherwise(1)
    votes = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line))
    union = F.size(F.array_distinct(F.flatten(F.collect_list("ats"))))
    return votes.groupBy("row", "doc_id", "template", "n_grams", "span").agg(F.min("diagonal").cast("long").alias("start"), F.count(F.lit(1)).alias("diagonals"), F.sum(F.size("ats")).alias("votes"), union.alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    rows = templates()
    label_of = F.create_map(*[x for i, label, *_ in rows for x in (F.lit(i), F.lit(label))])
    is_base = F.col("template").isin([i for i, _, base, _ in rows if base])
    t = spans(docs, rows)
    base = is_base & (F.col("found") == F.col("n_grams"))
    share = F.when(F.col("template") >= 0, F.col("found") / F.col("n_grams"))
    good = base | (~is_base & (F.col("template") >= 0) & (share >= COVERAGE))
    own = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, label_of[F.col("template")]))), ",")
    return t.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("start"))).alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        own(base).alias("base_labels"),
        own(good).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("row")
