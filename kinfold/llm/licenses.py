"""License scan by diagonal voting.

Each text is lower-cased and cut into words; every rolling k-word window is hashed and joined to
the windows of the templates.  A hit at word ``pos`` of the text and word ``tpos`` of a template
votes for the diagonal ``pos - tpos``, which is where the template would start.  Votes are kept as
a bit set over the template's windows, so counting them is idempotent: repeated rows don't vote twice.
Diagonals of one document and template that lie within ``gap`` words are merged (an inserted or a
dropped word moves the rest of a notice to the next diagonal), and a merged span is accepted
if its windows cover ``threshold`` of the template within a bounded stretch of the text.  A
diagonal that holds every window of a template is a verbatim occurrence.

The templates are a fixed table of a few hundred windows, so that side is broadcast; the windows of the corpus are
never shuffled, only the hits and one line per document are.

Hash hits are only candidates: before they vote, the words of the window are compared with those of the template.

Defined results: a null text is empty: no words, no labels, score 0.  Documents are told apart by id and text, so null
and repeated ids are safe, and every input row gets its own result row, in chunks where very many rows are equal.  Lower-casing is that of A-Z
alone, so no other letter makes a template word.  A very long text is one row of an array of hashes of its words, 8 bytes each, and its windows
aren't shuffled.  Where labels or spans tie, all are given, sorted; where diagonals tie, the lowest comes first.  An empty table gives an empty
result; further columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

#: Rows that one array holds while equal rows are spread out again.
CHUNK = 65_536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Separates words: ASCII but digits and lower-case letters.
SPLIT_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Words of a text that are dropped or inserted within one occurrence.
GAP = 4
THRESHOLD = 0.8

#: Phrases that count as base occurrences, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further notices, matched with tolerance.
NOTICES = (
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the terms of the mit license", "mit"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def templates() -> list[tuple[int, bool, str, list[str]]]:
    """(number, base or not, label, words), each of k to 62 + k words so that its windows fit a bit set."""
    rows = [(p, label, True) for p, label in BASE_PHRASES] + [(p, label, False) for p, label in NOTICES]
    return [(i, base, label, p.split()) for i, (p, label, base) in enumerate(rows)]


def _windows(spark: SparkSession) -> DataFrame:
    rows = []
    for tid, base, label, w in templates():
        n = len(w) - K + 1
        if not 1 <= n <= 62:
            raise ValueError(f"template {label} has {n} windows")
        rows += [(tid, base, label, len(w), n, j, *w[j : j + K]) for j in range(n)]
    t = spark.createDataFrame(rows, "tid int, base boolean, label string, t_words int, t_grams int, tpos int, a string, b string, c string")
    return t.select("*", F.xxhash64("a", "b", "c").alias("h"), F.array("a", "b", "c").alias("t_gram")).drop("a", "b", "c")


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gap: int = GAP, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and accepted span, and one without a span for each document.

    Columns: id, th (hash of the text), n_rows (equal rows), n_words, tid, base, label,
    first_word, last_word (of the span), exact, score.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("t"))
    d = d.select("id", F.xxhash64("t").alias("th"), F.filter(F.split(F.translate("t", _UPPER, _LOWER), SPLIT_RE), lambda x: x != "").alias("w"))
    grams = F.when(
        F.size("w") >= K,
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.size("w") - (K - 1)),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select("id", "th", "w", F.size("w").cast("long").alias("n_words"), grams.alias("g"))
    # Only windows whose hash is that of a template leave the row.  One scan does for both: position 0 stands for the document itself.
    known = [F.xxhash64(*[F.lit(x) for x in w[j : j + K]]) for _, _, _, w in templates() for j in range(len(w) - K + 1)]
    d = d.select("id", "th", "n_words", "w", "g", F.array_compact(F.transform("g", lambda h, i: F.when(h.isin(known), i + 1))).alias("p"))
    places = F.transform("p", lambda i: F.struct(i.alias("at"), F.get("g", i - 1).alias("h"), F.slice("w", i, K).alias("gram")))
    itself = F.struct(F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("array<string>").alias("gram"))
    d = d.select("id", "th", "n_words", F.explode(F.concat(F.array(itself), places)).alias("x")).select("id", "th", "n_words", "x.*")
    same = (F.col("h") == F.col("_h")) & (F.col("gram") == F.col("t_gram"))
    hits = d.join(F.broadcast(_windows(spark).withColumnRenamed("h", "_h")), same, "left").where((F.col("at") == 0) | F.col("tid").isNotNull())
    votes = hits.groupBy(
        "id", "th", "n_words", F.coalesce("tid", F.lit(-1)).alias("tid"), F.when(F.col("at") > 0, F.col("at") - 1 - F.col("tpos")).otherwise(0).alias("diag")
    ).agg(
        F.first("base").alias("base"),
        F.first("label").alias("label"),
        F.first("t_words").alias("t_words"),
        F.first("t_grams").alias("t_grams"),
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("bits"),
        F.min("at").alias("lo"),
        F.max("at").alias("hi"),
        F.sum((F.col("at") == 0).cast("long")).alias("n_rows"),
    )
    # Neighbouring diagonals of the same template in the same document.  Verbatim occurrences stand alone.
    votes = votes.withColumn("exact", F.bit_count("bits") == F.col("t_grams"))
    w = Window.partitionBy("id", "th", "tid").orderBy("diag")
    g = votes.withColumn("lone", F.col("exact") | F.lag("exact").over(w)).withColumn(
        "new", F.when(F.coalesce("lone", F.lit(False)) | (F.coalesce(F.col("diag") - F.lag("diag").over(w), F.lit(gap + 1)) > gap), 1).otherwise(0)
    )
    g = g.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = g.groupBy("id", "th", "n_words", "tid", "cluster").agg(
        F.first("base").alias("base"),
        F.first("label").alias("label"),
        F.first("t_words").alias("t_words"),
        F.first("t_grams").alias("t_grams"),
        F.bool_or("exact").alias("exact"),
        F.bit_count(F.bit_or("bits")).alias("covered"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("n_rows").alias("n_rows"),
    )
    # Verify: enough of the template, in a stretch of the text that isn't much longer than it.
    score = F.col("covered") / F.col("t_grams")
    whole = F.col("exact") | (~F.col("base") & (score >= threshold) & (F.col("hi") - F.col("lo") + K <= F.col("t_words") + 2 * gap))
    return merged.where((F.col("tid") < 0) | whole).select(
        "id", "th", "n_words", "tid", "base", "label", "exact", F.col("n_rows"),
        (F.col("lo") - 1).cast("long").alias("first_word"), (F.col("hi") + K - 2).cast("long").alias("last_word"), score.alias("score"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gap: int = GAP, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: counts and places of the base phrases, and the labels."""
    s = spans(docs, id_col, text, gap, threshold)
    is_base, is_span = F.col("base") & F.col("exact"), F.col("tid") >= 0
    per = s.groupBy("id", "th", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_span, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(is_span, F.col("score"))), F.lit(0.0)).alias("score"),
        F.sum(F.when(~is_span, F.col("n_rows")).otherwise(0)).alias("n_rows"),
    )
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / CHUNK).cast("long")))
    per = per.withColumn("chunk", chunks).withColumn("copies", F.least(F.col("n_rows") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int"))
    return per.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
