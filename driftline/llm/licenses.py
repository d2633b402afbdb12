"""License scans by diagonal voting.

The rolling word k-grams of all texts are joined on their hash with the k-grams of
the templates, a fixed list of short texts and so a broadcast of bounded size.
Each match votes for the diagonal (place in the text minus place in the template)
of its document and template; neighbouring diagonals, which arise from words added
or left out, are merged into bands, and a band is verified by the template words it
covers and the length of its span.  Words are compared too, so a hash never decides.

Only matching grams and one row a document are shuffled; texts are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import ALNUM_WORD, lower_ascii

# Base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Wordings by which licenses are named or granted, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

GRAM = 3
COVERED = 0.8  # of a template's grams, for a band to count
GAP_SHARE = 5  # diagonals merge up to one word apart for so many template words,
MAX_GAP = 3  # and never farther than this


def template_grams(spark: SparkSession, templates=None, phrases=None) -> DataFrame:
    """One row a template gram: its hash key words, place, and the template's label and size."""
    rows, number = [], 0
    listed = [(label, text, True) for text, label in (BASE_PHRASES if phrases is None else phrases).items()]
    listed += [(label, text, False) for label, text in (TEMPLATES if templates is None else templates)]
    for label, text, base in listed:
        words = text.split()
        k = min(GRAM, len(words))
        grams = len(words) - k + 1
        for place in range(grams):
            gram = [*words[place : place + k], None, None][:GRAM]
            rows.append((number, label, base, place, *gram, k, grams, len(words)))
        number += 1
    schema = ("template int, label string, base boolean, place int, t1 string, t2 string, t3 string, "
              "k int, grams int, template_words int")
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64("t1", "t2"))


def _rolling(words: Column) -> Column:
    rest = lambda n: F.slice(words, n, F.greatest(F.size(words), F.lit(0)))
    return F.arrays_zip(words.alias("w1"), rest(2).alias("w2"), rest(3).alias("w3"))


def scan(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", templates=None, phrases=None,
) -> DataFrame:
    """``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score`` of every row.

    ``n_base`` counts the places of all base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (NULL without one), labels
    are distinct, sorted and comma-joined, ``score`` is the largest covered part of
    a verified template (1 for a base phrase, 0 for none).  NULL and empty texts
    have no words; repeated rows give repeated results; NULL keys are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(lower_ascii(text), F.lit(ALNUM_WORD), F.lit(0))
    grams = F.broadcast(template_grams(docs.sparkSession, templates, phrases))
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(w) for w in ("w1", "w2", "w3")]))
    rolled = (
        docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), words.alias("_words"))
        # A row without words stands for the document itself.
        .select("_key", "_hash", F.size("_words").cast("long").alias("n_words"),
                F.posexplode(F.concat(nothing, _rolling(F.col("_words")))).alias("at", "g"))
        .select("_key", "_hash", "n_words", (F.col("at") - 1).alias("pos"),
                F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3"))
    )
    same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (
        F.col("t3").isNull() | (F.col("w3") == F.col("t3")))
    voted = (
        rolled.join(grams, F.when(F.col("w2").isNotNull(), F.xxhash64("w1", "w2")) == F.col("gram"), "left")
        .where((F.col("pos") < 0) | (F.col("template").isNotNull() & same))
        .withColumn("diagonal", F.col("pos") - F.col("place"))
    )
    doc = ["_key", "_hash"]
    diagonals = voted.groupBy(*doc, "n_words", "template", "label", "base", "k", "grams", "template_words", "diagonal").agg(
        F.count(F.lit(1)).alias("rows"), F.collect_set("place").alias("places"),
        F.min("pos").alias("begin"), F.max("pos").alias("end"))

    ordered = Window.partitionBy(*doc, "template").orderBy("diagonal")
    gap = F.when(F.col("base"), 0).otherwise(
        F.least(F.lit(MAX_GAP), F.floor(F.col("template_words") / GAP_SHARE)))
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) > gap).cast("int"), F.lit(1))
    bands = (
        diagonals.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(ordered))
        .groupBy(*doc, "n_words", "template", "label", "base", "k", "grams", "template_words", "band").agg(
            F.sum("rows").alias("rows"), F.min("begin").alias("begin"), F.max("end").alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"))
        .withColumn("part", F.col("covered") / F.col("grams"))
        .withColumn("sound", F.when(F.col("base"), F.col("part") == 1).otherwise(
            (F.col("part") >= COVERED)
            & (F.col("end") + F.col("k") - F.col("begin") <= F.col("template_words") + 2 * gap)))
    )
    joined = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    is_base = F.coalesce(F.col("base") & F.col("sound"), F.lit(False))
    found = bands.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("begin"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"), joined(F.col("sound")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("sound"), F.col("part"))), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
