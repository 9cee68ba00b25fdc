"""License scans by diagonal voting.

Every rolling k-gram of words of every document is hashed and joined to the (few, fixed) k-grams of license templates. A hit
at word p of the document and word t of the template votes for the diagonal p - t. Votes are summed by diagonal; diagonals of
one template that lie within `max_shift` words of each other (inserted or missing words) are merged into one span; a span
counts when enough of the template's k-grams were hit. Hits compare the words themselves, not just their hashes.

Base phrases are templates too: a base phrase stands where one diagonal holds all of its k-grams.

A span is verified by its k-grams: each counts once, compared word by word, and their share must reach `min_share`.

Nulls and empty texts: no words and no hits. Rows with equal id and text get equal results; a null id is a value like others. Of
overlapping templates all that reach their share give their labels. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

K = 3
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that are counted exactly, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Wordings of common licenses' notices, with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license version 3", "agpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
]


@dataclass(frozen=True)
class LicenseRules:
    """min_share: percent of a template's k-grams that a span must hold; max_shift: how far neighbouring diagonals may lie
    apart; templates, phrases: (words, label) pairs. The templates are broadcast: they are a parameter of a few thousand words
    at most, and do not grow with the data."""

    min_share: int = 75
    max_shift: int = 3
    templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)
    phrases: tuple[tuple[str, str], ...] = tuple(BASE_PHRASES)


def license_words(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NO_WORD), lambda w: w != "")


def template_grams(rules: LicenseRules) -> list[tuple[int, str, bool, int, int, str, str, str]]:
    """(template, label, is base, its k-grams, place, three words) for each k-gram of each template."""
    out = []
    for n, (text, label, base) in enumerate([(*p, True) for p in rules.phrases] + [(*t, False) for t in rules.templates]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        out += [(n, label, base, len(words) - K + 1, i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    return out


def template_table(spark: SparkSession, rules: LicenseRules) -> DataFrame:
    rows = template_grams(rules)
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, place int, t0 string, t1 string, t2 string").withColumn("h", F.xxhash64("t0", "t1", "t2"))


def hits(docs: DataFrame, rules: LicenseRules) -> DataFrame:
    """A row for each k-gram of a document that equals a k-gram of a template: key, template, place in both."""
    words = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), license_words(F.col("text")).alias("w")).where(F.size("w") >= K)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h")))
    rolled = words.select("doc_id", "text_hash", "w", F.explode(grams).alias("g")).select("doc_id", "text_hash", "w", F.col("g.at").alias("at"), F.col("g.h").alias("h"))
    word = lambda n: F.get("w", F.col("at") + n)
    met = rolled.join(F.broadcast(template_table(docs.sparkSession, rules)), "h").where((word(0) == F.col("t0")) & (word(1) == F.col("t1")) & (word(2) == F.col("t2")))
    return met.select("doc_id", "text_hash", "template", "label", "base", "grams", "place", "at", (F.col("at") - F.col("place")).alias("diagonal"))


def spans(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, base, first and last word, votes, grams."""
    key = ["doc_id", "text_hash", "template", "label", "base", "grams"]
    votes = hits(docs, rules).groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("lo"), (F.max("at") + K - 1).alias("hi"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    # a base phrase needs one whole diagonal; other templates join neighbouring ones
    new = F.when(F.col("base") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(1 << 30)) > rules.max_shift), 1).otherwise(0)
    merged = (
        votes.withColumn("new", new).withColumn("span", F.sum("new").over(by))
        .groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    )
    whole = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(100 * F.col("votes") >= rules.min_share * F.col("grams"))
    return merged.where(whole).drop("span", "template")


def scan_licenses(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share
    of a template that was found, 0 if none)."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(docs, rules).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max(F.col("votes") / F.col("grams")).alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    right = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.join(right, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
