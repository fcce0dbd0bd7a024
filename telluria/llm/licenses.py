"""Licence scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of a document's words is joined to the places it has in the
licence templates.  A hit at document word ``i`` and template word ``j`` votes
for the diagonal ``i - j``; votes are summed per document, template and diagonal,
neighbouring diagonals are merged (inserted or missing words shift a match by a
few places), and each merged span is verified: it must cover enough of the
template, and its words must be close to the template's by edit distance.

Base phrases are found by their own consecutive words in the same pass.

* Null text counts as empty; empty texts and texts below ``k`` words have no
  spans, but short phrases are still found in them.
* Rows are told apart by a row number of their own, fixed when the hits are
  written, so repeated ids give one result row each; a null id is kept.
* Templates and phrases are parameters; their tables are built from the code and
  therefore bounded, which is what allows the broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telluria.llm.text import alnum_words, documents
from telluria.session import materialize

# Phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Licence notices as their publishers word them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
)


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def template_places(spark, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """``template, label, place, size, body, gram`` for each k-gram of each template."""
    rows = [(n, label, body) for n, (label, body) in enumerate(templates) if len(body.split(" ")) >= k]
    each = (spark.createDataFrame(rows, "template int, label string, body string")
            .withColumn("w", F.split("body", " ")).withColumn("size", F.size("w"))
            .select("template", "label", "body", "size", "w",
                    F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("place")))
    return each.select("template", "label", "body", "size", "place", _gram(F.col("w"), F.col("place"), k).alias("gram"))


def license_hits(words: DataFrame, places: DataFrame, phrases: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """One row for each vote and each place of a phrase, and one for word 0 of
    each document; ``words`` has ``row_no``, ``doc_id`` and ``w``."""
    def stands(phrase: str) -> Column:
        return reduce(and_, [F.get("w", F.col("at") + j) == x for j, x in enumerate(phrase.split(" "))])

    label = reduce(lambda rest, p: F.when(stands(p[0]), p[1]).otherwise(rest), reversed(phrases),
                   F.lit(None).cast("string"))
    rolled = (words.select("row_no", "doc_id", "w", F.size("w").alias("n_words"))
              .withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)))))
              .select("row_no", "doc_id", "n_words", "w", "at", _gram(F.col("w"), F.col("at"), k).alias("gram"),
                      label.alias("phrase")))
    hits = rolled.join(F.broadcast(places), "gram", "left").where("template is not null or phrase is not null or at = 0")
    rest = F.when(F.col("template").isNotNull(),
                  F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("size") - F.col("place"))))
    return hits.select("row_no", "doc_id", "n_words", "at", "phrase", "template", "label", "place", "size", "body",
                       rest.alias("rest"))


def license_spans(hits: DataFrame, k: int, shift: int = 2, coverage: float = 0.6, closeness: float = 0.7) -> DataFrame:
    """Verified spans ``row_no, label, template, start, stop, score``.

    Diagonals at most ``shift`` apart vote together.  A span is kept if its votes
    cover ``coverage`` of the template's k-grams and its text differs from the
    template's by at most ``1 - closeness`` of the longer one's characters.
    """
    votes = hits.where("template is not null").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("row_no", "template", "label", "size", "body", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min("place").alias("first_place"), F.min_by("rest", "at").alias("rest"))
    order = Window.partitionBy("row_no", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > shift).cast("int")
    merged = (lines.withColumn("band", F.sum(F.coalesce(apart, F.lit(0))).over(order))
              .groupBy("row_no", "template", "label", "size", "body", "band")
              .agg(F.sum("votes").alias("votes"), F.min("first_at").alias("start"), F.max("last_at").alias("last_at"),
                   F.min_by("first_place", "first_at").alias("first_place"), F.min_by("rest", "first_at").alias("rest")))
    tail = F.concat_ws(" ", F.slice(F.split("body", " "), F.col("first_place") + 1, F.col("size")))
    scored = merged.withColumn("covered", F.least(F.lit(1.0), F.col("votes") / (F.col("size") - k + 1))).withColumn(
        "close", 1 - F.levenshtein("rest", tail) / F.greatest(F.length("rest"), F.length(tail)))
    return (scored.where((F.col("covered") >= coverage) & (F.col("close") >= closeness))
            .select("row_no", "label", "template", "start", (F.col("last_at") + k).alias("stop"),
                    (F.col("covered") * F.col("close")).alias("score")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  k: int = 3, shift: int = 2, coverage: float = 0.6, closeness: float = 0.7) -> DataFrame:
    """Per document: ``n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans``; ``spans`` is an array of verified spans, ``score`` 1 where a
    phrase stands, else that of the best span, else 0."""
    words = documents(df, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row_no"), alnum_words(F.col("text")).alias("w"))
    places = template_places(df.sparkSession, templates, k)
    hits = materialize(license_hits(words, places, phrases, k))  # row numbers are fixed from here on
    # A place of a phrase may come once for each template that has its k-gram.
    base = (hits.groupBy("row_no", "at", "phrase").agg(F.first("doc_id").alias("doc_id"),
                                                       F.first("n_words").alias("n_words"))
            .withColumn("starts", F.when(F.col("phrase").isNotNull(), F.col("at")))
            .groupBy("row_no").agg(
                F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
                F.count("phrase").alias("n_base"), F.min("starts").cast("long").alias("first_word"),
                F.max("starts").cast("long").alias("last_word"), F.collect_set("phrase").alias("base")))
    spans = (license_spans(hits, k, shift, coverage, closeness).groupBy("row_no")
             .agg(F.collect_set("label").alias("voted"), F.max("score").alias("best"),
                  F.sort_array(F.collect_list(F.struct("start", "stop", "label", "score"))).alias("spans")))
    none = F.array().cast("array<string>")
    return base.join(spans, "row_no", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("voted", none)))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")
