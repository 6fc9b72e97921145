"""Licence notices by diagonal voting, in DataFrame functions only.

All rolling 2-word grams of a document are hash-joined to the gram positions of the templates
(a fixed table of the library). A hit votes for the diagonal ``document place - template
place``; votes of a diagonal are a bit set of template places. Neighbouring diagonals, as words
put in or left out make them, are merged, and the span is verified by the share of template
grams found in it and by its length. A template all of whose grams lie on one diagonal stands
there word by word.

Defined cases: a null text is empty; a document without words has no labels and score 0; rows
that repeat a ``doc_id`` and its text get equal results; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.textops import documents

#: Phrases that are labelled wherever their words stand.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices and openings of licence texts, found approximately.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most this far apart are merged; share of grams (in percent) and extra words allowed in a span.
GAP, PERCENT, EXTRA = 2, 85, 4


def words(text: Column) -> Column:
    """Words in lower case. ``lower`` differs from A-Z only on letters that no template has."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """(label, base, grams, at, a, b): each gram of each template with its place."""
    rows = []
    for base, group in (("true", PHRASES), ("false", NOTICES)):
        for label, phrase in group:
            w = phrase.split()
            rows += [f"('{label}', {base}, {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}')" for i in range(len(w) - 1)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(label, base, grams, at, a, b)")


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, key, label, base, first_word, last_word (exclusive), places, first_place, last_place, share."""
    grams = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grams = grams.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    grams = grams.where(F.size("w") > 1).select("doc_id", "key", F.posexplode(pairs).alias("place", "g"))
    grams = grams.select("doc_id", "key", "place", F.col("g.a").alias("x"), F.col("g.b").alias("y"), F.xxhash64("g.a", "g.b").alias("hash"))
    known = template_grams(docs.sparkSession).withColumn("gram", F.xxhash64("a", "b"))
    hit = (F.col("hash") == F.col("gram")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    hits = grams.join(F.broadcast(known), hit)
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), at)")
    lines = hits.groupBy("doc_id", "key", "label", "base", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(bit).alias("votes"), F.min("place").alias("low"), (F.max("place") + 2).alias("high")
    )
    lines = lines.withColumn("whole", F.bit_count("votes") == F.col("grams"))
    ordered = Window.partitionBy("doc_id", "key", "label").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) > GAP).cast("int"), F.lit(1))
    lines = lines.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(ordered))
    merged = lines.groupBy("doc_id", "key", "label", "base", "grams", "cluster").agg(
        F.bit_or("votes").alias("votes"),
        F.min("low").alias("first_word"),
        F.max("high").alias("last_word"),
        F.sum(F.col("whole").cast("bigint")).alias("places"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("bigint").alias("first_place"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("bigint").alias("last_place"),
    )
    share = F.bit_count("votes") / F.col("grams")
    ends = F.expr("shiftright(votes, CAST(grams - 1 AS INT)) & 1") == 1
    close = ends & (F.bit_count("votes") * 100 >= F.col("grams") * PERCENT) & (F.col("last_word") - F.col("first_word") <= F.col("grams") + 1 + EXTRA)
    found = (F.col("places") > 0) | (~F.col("base") & close)
    return merged.where(found).select("doc_id", "key", "label", "base", "first_word", "last_word", "places", "first_place", "last_place", share.alias("share"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(labels)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("base")
    found = spans(docs).groupBy("doc_id", "key").agg(
        F.sum(F.when(base, F.col("places"))).alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).alias("first_word"),
        F.max(F.when(base, F.col("last_place"))).alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"),
        _joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "d", "key": "k"})
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select("doc_id", F.xxhash64(text).alias("key"), F.size(words(text)).cast("bigint").alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
