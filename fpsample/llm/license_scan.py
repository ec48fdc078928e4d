"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word pairs of a text are joined by hash to the positions of the same pairs in templates. A hit votes for its
diagonal (position in the text less position in the template). Votes are counted per diagonal, diagonals a few words apart
are merged (words put in or left out), and a span is verified by its share of the template's pairs, its length and its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fpsample.llm.common import LOWER, UPPER

#: What stands between words: every ASCII code point but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of public licenses (fixed values): found also with words changed, put in or left out.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gnu-gpl": "licensed under the gnu general public license",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Least share of a template's word pairs in a verified span; most words by which neighbouring diagonals differ.
MIN_SHARE, MAX_SHIFT = 0.6, 2


def fold_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def template_pairs(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """One row per word pair of a template: template, label, exact, pairs, at, a, b. Its size is that of the template list, not of the data."""
    listed = [(True, label, text) for text, label in phrases.items()] + [(False, label, text) for label, text in templates.items()]
    rows = []
    for template, (exact, label, text) in enumerate(listed):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"{text!r}: a template has at least two words")
        rows += [(template, label, exact, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    out = spark.createDataFrame(rows, "template int, label string, exact boolean, pairs int, at int, ta string, tb string")
    return F.broadcast(out.withColumn("pair_hash", F.xxhash64("ta", "tb")))


def scan_licenses(spark: SparkSession, docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, min_share: float = MIN_SHARE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each document.

    A phrase's places are diagonals on which all its pairs voted. A template's span needs votes for ``min_share`` of its
    pairs on diagonals of which neighbours differ by ``max_shift`` at most, at distinct template positions, within 1.5 times its length.
    ``score`` is the largest share of a verified span, 0 without any; ``spans`` the spans (label, first word, last word, share).

    Null and empty texts have no words: counts 0, first and last null, labels ''. Each row is a document of its own, also
    where ids are null or repeated; other columns than doc_id and text are not carried, whatever their names; an empty table
    gives an empty result. One scan, one shuffle by row, of hits and one row a document; the pairs of a text never leave its task.
    """
    pairs = template_pairs(spark, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), _BETWEEN), "").alias("words")
    own = F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc")  # by partition and place: the same when a task runs again
    rolled = docs.select(own, words).select("doc", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("pos", "pair"))
    rolled = rolled.select("doc", "pos", fold_az(F.col("pair.a")).alias("a"), fold_az(F.col("pair.b")).alias("b"))
    # The last pair of a text lacks its second word and matches nothing: it stays as the row that states the number of words.
    hits = rolled.join(pairs, (F.xxhash64("a", "b") == F.col("pair_hash")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & F.col("b").isNotNull(), "left")
    hits = hits.filter(F.col("template").isNotNull() | F.col("b").isNull())
    hits = hits.select("doc", F.coalesce("template", F.lit(-1)).alias("template"), "label", "exact", "pairs", "at", F.coalesce("pos", F.lit(-1)).alias("pos"), (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = hits.repartition("doc")

    votes = hits.groupBy("doc", "template", "label", "exact", "pairs", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("ats"), F.sum(F.when(F.col("template") < 0, F.col("pos").cast("long") + 1)).alias("words"))
    order = Window.partitionBy("doc", "template").orderBy("diagonal")
    # A diagonal joins its neighbour if it is near by and their words lie within one template's length.
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= max_shift) & ~F.col("exact") & (F.abs(F.col("lo") - F.lag("lo").over(order)) <= F.col("pairs"))
    merged = votes.withColumn("start", F.when(near, 0).otherwise(1)).withColumn("band", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("doc", "template", "label", "exact", "pairs", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.min("lo").alias("lo"), (F.max("hi") + 1).alias("hi"), F.sum("words").alias("words")
    )
    share = F.col("found") / F.col("pairs")
    verified = F.when(F.col("exact"), share == 1).otherwise((share >= min_share) & (F.col("hi") - F.col("lo") <= F.ceil(F.col("pairs") * 1.5)))
    base = verified & F.col("exact")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("doc").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct(F.col("lo").alias("first"), F.col("hi").alias("last"), "label", share.alias("share"))))).alias("spans"),
    ).select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
