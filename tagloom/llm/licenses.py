"""License scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is hashed and joined with the pairs of the license templates. A hit
of text place i on template place p votes for the diagonal i - p; an unbroken copy of a template puts all its
votes on one diagonal, an edited one on a few neighbouring ones. Votes are added up per text, template and
diagonal, neighbouring diagonals that also touch in the text are merged, and the span is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.texts import LOWER, NOT_WORD, UPPER, whole
from tagloom.session import stable

# fixed values: phrases that count wherever their words stand consecutively
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

# opening sentences and grants of well-known licenses; found when most of their words stand together
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by nc 4 0"),
]

COVERED = 0.6  # share of a passage's word pairs that must be there
VOTES = 2  # votes below which a diagonal of a passage is chance
APART = 3  # neighbouring diagonals differ by so many inserted or lost words
GAP = 12  # words between the ends of merged diagonals


def words(text: Column) -> Column:
    lowered = F.translate(whole(text), UPPER, LOWER)
    return F.array_remove(F.split(lowered, f"{NOT_WORD}+"), "")


def _pairs(rows: DataFrame) -> DataFrame:
    """Rolling pairs of ``words`` with their hash; a row without pairs gives one row of nulls."""
    pair = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("a"), F.get("words", i + 1).alias("b")))
    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.inline_outer(pair)).withColumn("hash", F.xxhash64("a", "b"))


def templates(spark: SparkSession, phrases=tuple(PHRASES), passages=tuple(PASSAGES)) -> DataFrame:
    """(template, label, exact, n_pairs, place, a, b, hash): the word pairs of all templates, some two hundred rows."""
    listed = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in passages]
    rows = F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("text"))
        for n, (label, text, exact) in enumerate(listed)])
    cut = spark.range(1).select(F.inline(rows)).withColumn("words", words(F.col("text"))).drop("text")
    return _pairs(cut.withColumn("n_pairs", F.size("words") - 1)).filter("b IS NOT NULL").select(
        "template", "label", "exact", "n_pairs", F.col("i").alias("place"), F.col("a").alias("t_a"), F.col("b").alias("t_b"),
        "hash")


def votes(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=tuple(PHRASES), passages=tuple(PASSAGES)) -> DataFrame:
    """The written hits, and for every row of ``docs`` its first pair, hit or not: (row, key, n_words, i, template, ...)."""
    listed = F.broadcast(templates(docs.sparkSession, phrases, passages))  # a fixed list
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    pairs = _pairs(cut.withColumn("n_words", F.size("words").cast("long")))
    # equal hashes are verified word by word here, so later steps need no text
    met = pairs.join(listed, (pairs["hash"] == listed["hash"]) & (pairs["a"] == listed["t_a"]) & (pairs["b"] == listed["t_b"]), "left")
    return stable(
        met.filter("template IS NOT NULL OR i IS NULL OR i = 0").select(
            "row", "key", "n_words", F.col("i").cast("long").alias("i"), "template", "label", "exact", "n_pairs", "place"), "votes")


def spans(voted: DataFrame) -> DataFrame:
    """(row, template, label, exact, first, last, score): verified places, word ranges with an exclusive end."""
    diagonals = (
        voted.filter("template IS NOT NULL").withColumn("diagonal", F.col("i") - F.col("place"))
        .groupBy("row", "template", "label", "exact", "n_pairs", "diagonal")
        .agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))
    )
    phrases = diagonals.filter(F.col("exact") & (F.col("n") == F.col("n_pairs"))).select(
        "row", "template", "label", "exact", "first", (F.col("last") + 2).alias("last"), F.lit(1.0).alias("score"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(
        (F.col("diagonal") - F.lag("diagonal").over(along) > APART) | (F.col("first") - F.lag("last").over(along) > GAP)
        | (F.lag("first").over(along) - F.col("last") > GAP), F.lit(True))
    merged = (
        diagonals.filter(~F.col("exact") & (F.col("n") >= VOTES)).withColumn("fresh", fresh.cast("int"))
        .withColumn("island", F.sum("fresh").over(along))
        .groupBy("row", "template", "label", "exact", "n_pairs", "island")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), (F.max("last") + 2).alias("last"))
    )
    share = F.least(F.lit(1.0), F.col("n") / F.col("n_pairs"))
    verified = (share >= COVERED) & (F.col("last") - F.col("first") <= 2 * (F.col("n_pairs") + 1))
    passages = merged.filter(verified).select("row", "template", "label", "exact", "first", "last", share.alias("score"))
    return phrases.unionByName(passages)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=tuple(PHRASES), passages=tuple(PASSAGES)) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels. Rows that repeat a key stay rows of their own. Other
    columns are not read; an empty table gives no rows.
    """
    voted = votes(docs, key, text, phrases, passages)
    rows = voted.filter("i IS NULL OR i = 0").select("row", "key", "n_words").distinct()
    base = F.when(F.col("exact"), F.col("first"))

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")  # a set of some ten labels

    found = spans(voted).groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        listed(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"),
        F.max("score").alias("score"))
    return rows.join(found, "row", "left").select(
        "key", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
