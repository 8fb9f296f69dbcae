"""License scan: text blocks that hold a license notice, by an exact set-similarity join.

A text's blocks are the windows of BLOCK words that begin every STRIDE words, so a
notice of up to BLOCK - STRIDE words stands whole in one of them, wherever its line
breaks are.  A block meets a template if it holds at least ``threshold`` of the
template's distinct words.

The texts are read once: of every document its template words are kept, and, if it
has enough words of any template at all, those of its blocks.  Words are ordered by
the number of documents that have them, rarest first.  A block that misses at most m
words of a template has one of its m + 1 rarest (prefix filter), so only these are
indexed.  A pair of block and template is taken at the first indexed word that both
have, if the block has enough words of any template (length filter) and both have
enough words left behind that one (positional filter); then the common words are
counted.  All these tests are proofs, so no block is missed.

Besides, phrases whose words stand consecutively are looked up directly; they give
the base labels, which stay.

All work is done by DataFrame functions.  Templates and phrases are arguments; with
the tokens' counts, one row a template word, they are all that the driver holds.

Defined results: a null or empty text has no words, labels are empty strings and the
score is 0; repeated rows, also of one doc_id, and rows without doc_id are each
scanned; an empty table gives no rows; other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BLOCK, STRIDE = 64, 32
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a lowered text the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F]; Java matches this form ten times as quickly.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
KELVIN = "\u212A"
#: Template words up to which their index is broadcast.
SMALL = 100_000

# fixed values: phrases of the base labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# fixed values: published license notices, or the sentence of a license that names it
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("epl", "under the terms of the eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free "
             "documentation license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
            "this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means "
                 "without the prior written permission"),
)


def words_of(text: Column) -> Column:
    """The words of a text of which A-Z are lowered.  Lowering all letters is quicker
    and leaves words as they are, but for non-ASCII letters in them, which no phrase
    and no template has; only the Kelvin sign would become an ASCII letter."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit(KELVIN)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively in the array, from 0."""
    parts = phrase.split()
    here = lambda i: reduce(Column.__and__, (F.get(words, i + k) == p for k, p in enumerate(parts)))
    known = reduce(Column.__and__, (F.array_contains(words, p) for p in parts))
    return F.when(known, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def frequencies(held: DataFrame, tokens: Sequence[str]) -> list[str]:
    """``tokens`` by the number of rows of ``held`` (held: tokens) that have them, rarest first."""
    counts = held.select(F.explode("held").alias("token")).groupBy("token").count()
    count = {r["token"]: r["count"] for r in counts.collect()}                     # a row a template word at most
    return sorted(tokens, key=lambda t: (count.get(t, 0), t))


def blocks_of(words: Column, held: Column, templates: Sequence[tuple[str, str]], threshold: float) -> Column:
    """The template words of each block; null if the text has too few words of every
    template.  ``held``: the text's template words."""
    parts = [sorted(set(t.split())) for _, t in templates]
    known = F.array(*(F.struct(_strings(p).alias("words"), F.lit(needed(len(p), threshold)).alias("need")) for p in parts))
    enough = F.exists(known, lambda t: F.size(F.array_intersect(held, t["words"])) >= t["need"])
    tokens = _strings(sorted({w for p in parts for w in p}))
    block = lambda b: F.array_intersect(tokens, F.slice(words, b * STRIDE + 1, BLOCK))
    last = F.floor((F.size(words) - 1) / STRIDE).cast("int")
    return F.when(enough, F.transform(F.sequence(F.lit(0), last), block))


def needed(size: int, threshold: float) -> int:
    """Of ``size`` words, how many a block must have."""
    return max(1, math.ceil(size * threshold - 1e-9))


def indexed(templates: Sequence[tuple[str, str]], order: Sequence[str], threshold: float) -> list[tuple]:
    """(token, label, words, at, need) for each of a template's rarest words, one of
    which a block must have, with its place among the template's words."""
    rank, rows = {t: k for k, t in enumerate(order)}, []
    for label, text in templates:
        mine = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(mine), threshold)
        rows += [(mine[k], label, mine, k, need) for k in range(len(mine) - need + 1)]
    return rows


def as_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``indexed`` rows as a table."""
    out = spark.range(1).select(F.inline(F.array(*(F.struct(
        F.lit(t).alias("token"), F.lit(label).alias("label"), _strings(mine).alias("words"), F.lit(k).alias("at"),
        F.lit(need).alias("need")) for t, label, mine, k, need in rows))))
    return F.broadcast(out) if sum(len(r[2]) for r in rows) <= SMALL else out


def joined(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, block, label, containment) of the pairs that meet the threshold;
    ``blocks``: (row, block, held: template words, rarest first)."""
    probe = blocks.select("row", "block", "held", F.posexplode("held").alias("nth", "token"))
    common = F.size(F.array_intersect("held", "words"))
    return (probe.join(templates, "token")
            .filter((F.size("held") >= F.col("need")) & (F.size("held") - F.col("nth") >= F.col("need"))
                    & (F.size("words") - F.col("at") >= F.col("need")))
            .filter(~F.arrays_overlap("held", F.slice("words", F.lit(1), F.col("at"))))       # the first common word
            .filter(common >= F.col("need"))
            .select("row", "block", "label", (common / F.size("words")).alias("containment")))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
         phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``templates`` (at least one): (label, words), ``phrases``: (words, label).
    Returns the documents, a row each (row, doc_id, n_words, n_base, first_word, last_word,
    base: array of labels), and the blocks that meet a template (row, block, label,
    containment); block b begins at word b * STRIDE."""
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    tokens = sorted({w for _, text in templates for w in text.split()})
    at = worded.select("doc_id", "words", F.array_intersect(_strings(tokens), F.col("words")).alias("held"), *(places(F.col("words"), p).alias(f"at{k}") for k, (p, _) in enumerate(phrases)))
    every = F.concat(F.array().cast("array<int>"), *(F.col(f"at{k}") for k in range(len(phrases))))
    base = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.size(f"at{k}") > 0, label)
                                                                 for k, (_, label) in enumerate(phrases))))
    facts = stored(at.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), base.alias("base"),
        "held", blocks_of(F.col("words"), F.col("held"), templates, threshold).alias("blocks")), "license-facts")
    order = frequencies(facts, tokens)
    blocks = (facts.filter("blocks IS NOT NULL").select("row", F.posexplode("blocks").alias("block", "held"))
              .withColumn("held", F.array_intersect(_strings(order), F.col("held"))))
    rows = indexed(templates, order, threshold)
    return facts.drop("held", "blocks"), joined(blocks, as_table(docs.sparkSession, rows))


def license_labels(docs: DataFrame, **options) -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels (base and the join's), score: 1 if a base phrase stands in the text, else
    the largest containment of a template that a block meets, else 0; n_blocks:
    blocks that meet a template."""
    facts, found = scan(docs, **options)
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"),
                                      F.count_distinct("block").alias("n_blocks"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return facts.join(by_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _values(pairs: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in pairs)


#: Every block against every template.
OP12_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
  FROM documents),
phrases(label, phrase) AS (VALUES {_values([(label, p) for p, label in PHRASES])}),
templates(label, words) AS (VALUES {_values(TEMPLATES)}),
starts AS (SELECT r, words, unnest(range(0, len(words))) AS i FROM w),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM starts JOIN phrases ON words[i + 1] = phrase[1] AND words[i + 1:i + len(phrase)] = phrase GROUP BY r),
blocks AS (SELECT r, b, list_distinct(words[{STRIDE} * b + 1:{STRIDE} * b + {BLOCK}]) AS held
           FROM (SELECT r, words, unnest(range(0, (len(words) + {STRIDE - 1}) // {STRIDE})) AS b FROM w)),
pairs AS (
  SELECT r, b, label, len(list_intersect(held, list_distinct(t.words))) AS n, len(list_distinct(t.words)) AS size
  FROM blocks CROSS JOIN templates t),
met AS (SELECT r, list(DISTINCT label) AS more, max(n / size) AS best, count(DISTINCT b) AS n_blocks FROM pairs
        WHERE n >= ceil(size * {THRESHOLD} - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM w LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""
