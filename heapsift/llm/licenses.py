"""License scans by diagonal voting: rolling word k-grams of documents meet the positions of license templates, and votes add up along diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_ALNUM, lower_ascii, words
from .decontaminate import rolling_hashes, word_hashes

#: Fixed phrases and their labels. Each place of one counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening passages and notices of well-known public licenses, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: Words of a k-gram of templates, and of the anchor of a phrase; steps between diagonals that are merged; share of a template's k-grams that a span must hold.
K, ANCHOR, GAP, SHARE = 5, 2, 4, 0.5


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """A row for each position of a template: t, label, phrase (whether it is a base phrase), at, k, grams (to be found as they are), total (k-grams of the template), h (of the first k)."""
    rows = [(i, label, p, True) for i, (p, label) in enumerate(PHRASES.items())] + [(len(PHRASES) + i, label, text, False) for i, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "t int, label string, text string, phrase boolean").withColumn("w", words(lower_ascii(F.col("text")), WORD_ALNUM))
    k = F.when(F.col("phrase"), F.lit(ANCHOR)).otherwise(F.lit(K))
    last = F.when(F.col("phrase"), F.lit(0)).otherwise(F.size("w") - K)
    t = t.withColumn("k", k).withColumn("total", last + 1).select("t", "label", "phrase", "k", "total", "w", F.explode_outer(F.sequence(F.lit(0), last)).alias("at"))
    grams = F.when(F.col("phrase"), F.col("w")).otherwise(F.slice("w", F.col("at") + 1, F.col("k")))
    return t.select("t", "label", "phrase", "k", "total", "at", grams.alias("grams")).withColumn("h", F.xxhash64(word_hashes(F.slice("grams", 1, F.col("k")))))


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """For each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (array of struct<label, start, len, share>).

    A phrase is found wherever its words stand consecutively. For a template, each k-gram that occurs in a document votes for the diagonal
    of their offsets; diagonals of one document and template at most GAP apart are merged, as an inserted or missing word shifts the offset;
    the merged span is verified if it holds SHARE of the template's k-grams, each counted once. score is 1 with a phrase, else the best
    verified share, else 0. A null or empty text has no words. Rows equal in doc_id and text give one row together; a null doc_id is kept.
    The templates are constants of a few hundred k-grams, so they are broadcast; only hits leave the map tasks.
    """
    grams = F.broadcast(template_grams(documents.sparkSession, templates))
    docs = documents.select("doc_id", F.xxhash64("text").alias("id"), F.length("text").alias("chars"), words(lower_ascii(F.col("text")), WORD_ALNUM).alias("w"))
    rows = rolling_hashes(docs.withColumn("wh", word_hashes("w")), [ANCHOR, K], "doc_id", "id", "chars", "w")
    first = F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("width") == ANCHOR))  # stands for the document
    hits = rows.join(grams, F.col("hash") == F.col("h"), "left").where(first | F.col("h").isNotNull())
    ok = (F.col("width") == F.col("k")) & (F.slice("w", F.col("pos") + 1, F.size("grams")) == F.col("grams"))
    hits = hits.withColumn("hit", F.coalesce(ok, F.lit(False))).where(first | F.col("hit"))
    on = F.when(F.col("hit"), F.col("pos") - F.col("at"))
    key = ["doc_id", "id", "chars"]
    template = F.when(F.col("hit"), F.col("t"))
    voted = hits.select(*key, F.size("w").alias("n_words"), template.alias("t"), on.alias("diagonal"), F.when(F.col("hit"), F.col("pos")).alias("pos"), F.when(F.col("hit"), F.col("at")).alias("at"), "label", "phrase", "total", F.size("grams").alias("long"))
    voted = voted.groupBy(*key, "t", "diagonal").agg(F.max("n_words").alias("n_words"), F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("long")).alias("hi"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("total").alias("total"))
    by = Window.partitionBy(*key, "t").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP) | F.col("phrase"), F.lit(True))
    merged = voted.withColumn("span", F.sum(fresh.cast("int")).over(by)).groupBy(*key, "t", "span").agg(
        F.max("n_words").alias("n_words"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("label").alias("label"), F.max("phrase").alias("phrase"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.max("total")).alias("share"),
    )
    base = F.col("phrase") & F.col("t").isNotNull()
    good = F.col("t").isNotNull() & (base | (F.col("share") >= SHARE))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return merged.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("label", F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("len"), "share")))).alias("spans"),
    ).drop("id", "chars")


def report(documents: DataFrame) -> DataFrame:
    """scan() without the spans."""
    return scan(documents).drop("spans")
