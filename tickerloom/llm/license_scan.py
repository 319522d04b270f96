"""Licence notices by an exact set-similarity join of text blocks with notice templates.

A block is ``block_words`` consecutive words; blocks begin every half block, so a notice
of up to half a block lies whole in one.  A template is found in a block that holds at
least ``percent`` of its distinct words.  The words of all templates are ordered by the
number of blocks of the whole corpus that hold them, rarest first, and a block's words
take that order.  With n and m words and k wanted in common:

* length filter: a block with m < k words of the order is no partner;
* prefix filter: partners share one of the first n - k + 1 words of the template and
  one of the first m - k + 1 of the block, so only those are joined;
* positional filter: a pair is taken at its first common word, and only if both have
  enough words left behind it.

What is left is counted whole.  All of it is DataFrame functions; only the templates'
words (bounded by the templates given, never by the corpus) are collected or broadcast.

Defined cases: a null text is empty and has no words, no labels and score 0; texts of
any length are read whole; equal rows (also with null ids) each give a row; an empty
table gives no rows; other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text, text_key

#: what stands between words: ASCII without digits and lower-case letters
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: phrases whose places are counted, with their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# fixed values: notices that public licences ask their users to place, in words as they are compared
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "public-domain": ("this is free and unencumbered software released into the public domain",),
    "all-rights-reserved": ("all rights reserved no part of this publication may be reproduced distributed or transmitted in any form",),
}


def lowered(text: Column) -> Column:
    """Text in lower case; the one other character whose lower case is an ASCII letter (U+212A) is put aside first.

    Other letters may change as well, but no word of ASCII letters and digits comes or
    goes by that, and only such words are looked for.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def split_words(low: Column) -> Column:
    return F.array_remove(F.split(low, BETWEEN), "")


def places(phrase: str) -> Column:
    """Starts of a phrase in ``words``; texts that lack one of its words aren't walked."""
    parts = phrase.split()
    may = F.size("words") >= len(parts)
    for part in set(parts):
        may = may & F.contains("low", F.lit(part))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - len(parts)))

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & (F.get("words", i + k) == part)
        return out

    return F.when(may, F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def block_vocabulary(texts: DataFrame, vocabulary: Sequence[str], block_words: int) -> DataFrame:
    """text_tag and, for every block, the words of the vocabulary that it holds, in the vocabulary's order."""
    step, known = block_words // 2, F.array(*map(F.lit, vocabulary))
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - block_words) / step)).cast("int")
    numbers = F.when(F.size("words") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    held = F.transform(numbers, lambda no: F.array_intersect(known, F.slice("words", no * step + 1, F.lit(block_words))))
    return texts.select("text_tag", F.explode(held).alias("held"))


def word_order(texts: DataFrame, vocabulary: Sequence[str], block_words: int) -> list[str]:
    """The templates' words, those of the fewest blocks of the corpus first (ties by the word)."""
    held = block_vocabulary(texts, vocabulary, block_words).select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in held.collect()}  # no more rows than the templates have words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def notice_hits(texts: DataFrame, templates: Mapping[str, Sequence[str]], percent: int, block_words: int) -> DataFrame:
    """text_tag, label and score of every (block, template) pair that meets the threshold."""
    spark = texts.sparkSession
    notices = [(label, sorted(set(t.split()))) for label, ts in templates.items() for t in ts]
    if not all(w.isascii() and w.isalnum() for _, words in notices for w in words):
        raise ValueError("a template consists of words of ASCII letters and digits")
    if any(len(t.split()) > block_words // 2 or not t.split() for ts in templates.values() for t in ts):
        raise ValueError("a template has from one word to half a block")
    order = word_order(texts, sorted({w for _, words in notices for w in words}), block_words)
    index = []
    for no, (label, words) in enumerate(notices):
        ordered = [w for w in order if w in set(words)]
        least = -(-percent * len(ordered) // 100)
        index += [(w, at, no, label, ordered, least) for at, w in enumerate(ordered[: len(ordered) - least + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "word string, t_at int, notice int, label string, template array<string>, least int"))
    fewest = min(least for *_, least in index)
    heads = {w for w, *_ in index}
    ranked = block_vocabulary(texts, order, block_words).withColumnRenamed("held", "ranked")
    # the longest prefix that any template asks for
    long = ranked.where(F.size("ranked") >= fewest).where(F.arrays_overlap("ranked", F.array(*map(F.lit, sorted(heads)))))
    keyed = long.select("text_tag", "ranked", F.posexplode(F.slice("ranked", F.lit(1), F.size("ranked") - fewest + 1)).alias("b_at", "word"))
    left = F.size("ranked") - F.col("b_at")
    pairs = keyed.join(prefixes, "word").where((F.size("ranked") >= F.col("least")) & (left >= F.col("least")))
    common = pairs.withColumn("common", F.array_intersect("template", "ranked"))
    first = common.where((F.get("common", F.lit(0)) == F.col("word")) & (F.size("common") >= F.col("least")))
    return first.select("text_tag", "label", (F.size("common") / F.size("template")).alias("score"))


def license_labels(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    percent: int = 80,
    block_words: int = 96,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is the largest share of a template's words found in a block, 1 where a
    phrase is found and 0 where nothing is.
    """
    texts = id_and_text(docs, id_col, text_col).select("doc_id", text_key().alias("text_tag"), lowered(F.col("text")).alias("low"))
    texts = texts.withColumn("words", split_words(F.col("low")))
    found = [(label, places(phrase)) for phrase, label in phrases.items()]
    base = texts.select("doc_id", "text_tag", F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{k}") for k, (_, p) in enumerate(found)])
    at = F.concat(*[F.col(f"p{k}") for k in range(len(found))])
    held = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(found)]))
    base = base.select(
        "doc_id",
        "text_tag",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(held)).alias("own"),
    )
    hits = notice_hits(texts, templates, percent, block_words)
    # no more entries than there are labels
    by_text = hits.groupBy("text_tag").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    both = base.join(by_text, "text_tag", "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(spark_templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, percent: int = 80, block_words: int = 96) -> str:
    """The same rows by comparing every block with every template, in SQL."""
    notices = ", ".join(f"('{label}', {sorted(set(t.split()))})" for label, ts in spark_templates.items() for t in ts)
    step, sought = block_words // 2, ", ".join(f"('{label}', {p.split()})" for p, label in phrases.items())
    return rf"""
    WITH rows AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM rows),
    sought(label, parts) AS (VALUES {sought}),
    found AS (
        SELECT id, label, i FROM (SELECT id, label, parts, words, unnest(range(0, greatest(0, len(words) - len(parts) + 1))) AS i FROM w, sought)
        WHERE words[i + 1 : i + len(parts)] = parts),
    base AS (SELECT id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS own FROM found GROUP BY id),
    blocks AS (
        SELECT id, words[no * {step} + 1 : no * {step} + {block_words}] AS block
        FROM (SELECT id, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - {block_words}) / {step}::DOUBLE)) AS BIGINT) + 1)) AS no FROM w WHERE len(words) > 0)),
    notices(label, parts) AS (VALUES {notices}),
    hits AS (
        SELECT id, list(DISTINCT label) AS more, max(n / t::DOUBLE) AS best
        FROM (SELECT id, label, len(list_intersect(parts, block)) AS n, len(parts) AS t FROM blocks, notices)
        WHERE 100 * n >= {percent} * t GROUP BY id)
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
        coalesce(array_to_string(own, ','), '') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
        CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM w LEFT JOIN base USING (id) LEFT JOIN hits USING (id)"""
