"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import durable, row_key

#: Characters between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a template's distinct words that a block must hold.
THRESHOLD = 90
#: Blocks for templates of so many words at least, doubled until a template fits.
LEAST_STEP = 16
#: Bytes of template text joined in one pass over the documents; bounds what is broadcast.
BLOCK_BYTES = 1 << 20

# fixed values: phrases and the license they name
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: notices that licenses ask to be shown, and their labels
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
)


def plain(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each between single spaces; a missing or wordless text is one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.concat(F.lit(" "), lower, F.lit(" "))
    return F.regexp_replace(spaced, GAP, " ")


def words_of(spaced: Column) -> Column:
    """Array of the words of a plain text."""
    return F.when(F.length(spaced) > 1, F.split(F.trim(spaced), " ", -1)).otherwise(F.array().cast("array<string>"))


def template_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(GAP, lower) if w]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(spaced: Column, n_words: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels (an array) of a plain text.

    A phrase counts wherever its words stand one after the other, overlapping places too.
    """
    total, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in phrases:
        known = " ".join(template_words(phrase))
        held = F.contains(spaced, F.lit(f" {known} "))
        total = total + F.when(held, F.regexp_count(spaced, F.lit(rf"(?<= )(?={re.escape(known)} )"))).otherwise(0)
        upto = F.substring(spaced, F.lit(1), F.locate(f" {known} ", spaced))
        backward = F.reverse(spaced)
        after = F.substring(backward, F.lit(1), F.locate(f" {known[::-1]} ", backward))
        firsts.append(F.when(held, _spaces(upto) - 1))
        lasts.append(F.when(held, n_words - (_spaces(after) - 1) - len(known.split(" "))))
        labels.append(F.when(held, F.lit(label)))
    nothing = F.lit(None).cast("int")
    return {
        "n_base": total.cast("bigint"),
        "first_word": F.least(*firsts, nothing).cast("bigint"),
        "last_word": F.greatest(*lasts, nothing).cast("bigint"),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def step_of(n_words: int) -> int:
    """Distance of the blocks that templates of so many words are joined with."""
    step = LEAST_STEP
    while step < n_words:
        step *= 2
    return step


def blocks(steps: Sequence[int]) -> Column:
    """Start and step of every block of ``words``: 2 x step words at every multiple of step.

    So any run of up to step words lies whole in a block, and the blocks cover the text.
    """
    n = F.size("words")

    def of(step: int) -> Column:
        last = F.greatest(F.ceil(n / F.lit(step)).cast("int") - 2, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.lit(step).alias("step"), (b * step).alias("start")))

    return F.concat(*[of(s) for s in steps])


def _parts(templates: Sequence[tuple[str, str]]) -> Iterator[list[tuple[str, list[str]]]]:
    """Templates as distinct words, in parts of bounded size."""
    part, size = [], 0
    for label, text in templates:
        words = template_words(text)
        if not words:
            continue
        cost = sum(len(w.encode()) for w in words)
        if part and size + cost > BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append((label, words))
        size += cost
    if part:
        yield part


def _joined(split: DataFrame, part: list[tuple[str, list[str]]], threshold: int) -> DataFrame:
    """Blocks that hold enough words of a template: (__k1, __k2, label, step, start, overlap, words).

    Words are ordered by the number of documents that hold them, rarest first. A
    template and a block that share enough words share one of the first
    size - needed + 1 words of the template (prefix filter), the block holds
    enough template words at all (length filter), and behind the first shared
    word both have enough words left (positional filter). What passes is counted.
    """
    spark = split.sparkSession
    vocabulary = sorted({w for _, words in part for w in words})
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "token string"))
    held = split.select(F.explode(F.array_distinct("words")).alias("token")).join(known, "token")
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, steps = [], set()
    for label, words in part:
        tokens = sorted(set(words), key=rank.__getitem__)
        needed = -(-threshold * len(tokens) // 100)
        step = step_of(len(words))
        if sum(w in counts for w in tokens) < needed:
            continue  # the documents together do not hold enough of it
        steps.add(step)
        prefix = tokens[: len(tokens) - needed + 1]
        index += [(step, w, at, needed, label, tokens, prefix) for at, w in enumerate(prefix)]
    kind = "step int, token string, at int, needed int, label string, tokens array<string>, prefix array<string>"
    sent = F.broadcast(spark.createDataFrame(index, kind))
    some = split.filter(F.size("words") > 0)
    cut = some.select("__k1", "__k2", "words", F.explode(blocks(sorted(steps) or [LEAST_STEP])).alias("b"))
    cut = cut.select(
        "__k1", "__k2", "b.step", "b.start", F.array_distinct(F.slice("words", F.col("b.start") + 1, F.col("b.step") * 2)).alias("held")
    )
    met = cut.select("__k1", "__k2", "step", "start", "held", F.explode("held").alias("token")).join(sent, ["step", "token"])
    ordered = F.array_intersect(F.lit(order), "held")
    place = F.array_position("ordered", F.col("token")).cast("int") - 1
    near = (
        met.filter(F.get(F.array_intersect("prefix", "held"), F.lit(0)) == F.col("token"))
        .withColumn("ordered", ordered)
        .filter(F.size("ordered") >= F.col("needed"))
        .filter(1 + F.least(F.size("tokens") - 1 - F.col("at"), F.size("ordered") - 1 - place) >= F.col("needed"))
    )
    return near.select(
        "__k1", "__k2", "label", "step", "start", F.size(F.array_intersect("tokens", "held")).alias("overlap"),
        F.size("tokens").alias("words"), "needed",
    ).filter("overlap >= needed").drop("needed")


def matching_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Every (block, template) with enough shared words: doc_id, label, start, end (words from 0, end exclusive), overlap, words.

    A template of up to 16, 32, 64, ... words is joined with blocks of twice as
    many words, which overlap by half. Blocks of rows equal in id and text come
    out once. Missing and wordless texts have no block.
    """
    split = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", words_of(plain(F.col("text"))).alias("words"))
    ids = split.groupBy("__k1", "__k2").agg(F.first("doc_id").alias("doc_id"))
    found = _found(split.drop("doc_id"), templates, threshold)
    return found.join(ids, ["__k1", "__k2"]).select(
        "doc_id", "label", "start", (F.col("start") + 2 * F.col("step")).alias("end"), "overlap", "words"
    )


def _found(split: DataFrame, templates: Sequence[tuple[str, str]], threshold: int) -> DataFrame:
    parts = [_joined(split, part, threshold) for part in _parts(templates)]
    if not parts:
        kind = "__k1 bigint, __k2 bigint, label string, step int, start int, overlap int, words int"
        return split.sparkSession.createDataFrame([], kind)
    return reduce(DataFrame.union, parts).distinct()


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score, one row per row of docs.

    Labels are those of the phrases and of the matching templates; score is the
    largest share of a matching template's words that a block holds, 0 without a
    match. Missing, empty and wordless texts have no words and no labels. Rows
    equal in id and text come out alike, each of them. Only ``doc_id`` and
    ``text`` are read. Templates are bounded by parts; their words, not the
    documents, are broadcast. Documents meet their matches, one row each, by a
    shuffled join on a hash of id and text; rows that are all alike would crowd
    one partition, which adaptive execution splits.
    """
    spaced = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", plain(F.col("text")).alias("spaced"))
    split = spaced.select("__k1", "__k2", words_of(F.col("spaced")).alias("words"))
    found = durable(_found(split, templates, threshold))
    per_doc = found.groupBy("__k1", "__k2").agg(
        F.collect_set("label").alias("__more"), F.max(F.col("overlap") / F.col("words")).alias("__score")
    )
    counted = spaced.withColumn("n_words", F.greatest(_spaces(F.col("spaced")) - 1, F.lit(0)).cast("bigint"))
    digest = counted.select("__k1", "__k2", "doc_id", "n_words", *[c.alias(n) for n, c in phrase_places(F.col("spaced"), F.col("n_words"), phrases).items()])
    none = F.array().cast("array<string>")
    return digest.join(per_doc, ["__k1", "__k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("__more", none))).alias("labels"),
        F.coalesce("__score", F.lit(0.0)).alias("score"),
    )
