"""License scan by diagonal voting.

The rolling hashes of all ``GRAM`` consecutive words of every text are joined with
the gram positions of the license templates (a fixed list, so its broadcast is
bounded). A hit at word p of the text and word t of a template votes for the
diagonal p - t. Diagonals that lie within ``SLACK`` of the one before, with words
that follow within ``REACH``, are merged, which bridges inserted and dropped words.
A merged span is verified by the share of the template's grams it holds: at
least ``COVERAGE`` gives the template's label. A diagonal that holds every gram of a
phrase is an exact place of that phrase.

All of it is DataFrame operations on one scan; texts are not shuffled.

Cases: a null or empty text has no words, no labels and score 0. Rows that repeat
an id each get their own result. Labels that tie are all named. Texts may be of any
length. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
SLACK = 3
REACH = 8
COVERAGE = 0.6

#: Label and phrase; every exact place of a phrase is counted.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Label and words of public license notices, found also in part.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words of a text. lower() changes no word that a template holds, but for the Kelvin sign."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _gram(words: Column, at: Column | int) -> Column:
    return F.xxhash64(*[F.get(words, F.lit(at) + k if isinstance(at, int) else at + k) for k in range(GRAM)])


def templates(spark) -> DataFrame:
    """template, label, is_phrase, grams (how many), t (word), gram (hash)."""
    rows = [(i, label, i < len(PHRASES), text.split()) for i, (label, text) in enumerate([*PHRASES, *NOTICES])]
    made = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, words array<string>")
    made = made.withColumn("grams", F.size("words") - GRAM + 1).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    return made.select("template", "label", "is_phrase", "grams", "t", _gram(F.col("words"), F.col("t")).alias("gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_array(F.col(f"`{text_col}`")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    rolled = F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda p: _gram(F.col("w"), p))
    # the first entry stands for the text itself, so that texts without hits stay
    grams = F.concat(F.array(F.lit(0).cast("long")), F.when(F.size("w") >= GRAM, rolled).otherwise(F.array().cast("array<long>")))
    # the words are dropped before their grams become rows, or each row would carry them all
    rolled = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), grams.alias("grams"))
    rolling = rolled.select("row", "doc_id", "n_words", F.posexplode("grams").alias("p", "gram"))
    known = templates(spark).unionByName(spark.createDataFrame([(-1, None, False, 1, 0, 0)], "template int, label string, is_phrase boolean, grams int, t int, gram long"))
    hits = rolling.join(F.broadcast(known), "gram").where("template >= 0 OR p = 0").withColumn("p", F.col("p") - 1)
    one = ["row", "doc_id", "n_words", "template", "label", "is_phrase", "grams"]
    diagonals = hits.groupBy(*one, (F.col("p") - F.col("t")).cast("long").alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.min("p").alias("low"), F.max("p").alias("high")
    )
    order = Window.partitionBy(*one).orderBy("low", "diagonal")
    apart = F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SLACK) | (F.col("low") - F.lag("high").over(order) > REACH), F.lit(True))
    spans = diagonals.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = (F.col("is_phrase") & (F.size("ts") == F.col("grams"))).cast("long")
    spans = spans.groupBy(*one, "span").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("ts")))) / F.col("grams")).alias("coverage"),
        F.sum(whole).alias("places"),
        F.min(F.when(whole == 1, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole == 1, F.col("diagonal"))).alias("last"),
    )
    real = F.col("template") >= 0
    good = real & (F.col("coverage") >= COVERAGE)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(real, F.col("places")).otherwise(0)).alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when(good | (F.col("places") > 0), F.col("label"))).alias("labels"),
        F.max(F.when(good, F.col("coverage")).otherwise(0.0)).alias("score"),
    ).drop("row")
