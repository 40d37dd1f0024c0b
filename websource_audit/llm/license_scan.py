"""License scans as an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Tokens are ordered by global document frequency, rarest first. A block that holds at least ceil(t m) of a template's m
distinct tokens holds one of its first m - ceil(t m) + 1; blocks are found by those prefix tokens, then held against
length and position bounds, then counted exactly. Templates are few and fixed, so their tokens travel as literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_sums

#: Hundredths of a template's distinct tokens that a block must hold.
CONTAINMENT_PERCENT = 85

# Phrases and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Sentences by which licenses are declared or recognised.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Between paragraphs, in a lower-cased text: one line or more without words.
BREAK = rf"\n{GAPS[:-1]}*\n"
#: A paragraph meets a template within so many times the template's words in a row.
SPAN = 2
#: Tokens that a run of words must hold whatever the percentage, as they tell one label from another.
MUST = {"cc-by-nc": ("nc",)}

MATCHES = "array<struct<block:int,template:int,label:string,shared:int,score:double>>"


def need(m: int, percent: int = CONTAINMENT_PERCENT) -> int:
    return -(-m * percent // 100)


def template_tokens(text: str) -> list[str]:
    """Distinct tokens of a template, in first-seen order."""
    return list(dict.fromkeys(re.sub(GAPS, " ", text.lower()).split()))


def padded(text: Column) -> Column:
    """The words, each after one space, and a space at the end; an empty or null text is two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, " ")), F.lit(" "))


def word_count(pad: Column) -> Column:
    """Words of a padded text: one space before each, one at the end."""
    return F.when(F.length(pad) == 2, F.lit(0)).otherwise(F.length(pad) - F.length(F.replace(pad, F.lit(" "), F.lit(""))) - 1).cast("long")


def phrase_starts(pad: Column, phrase: str) -> Column:
    """Word positions from 0 where the phrase's words stand consecutively; each piece holds as many words as spaces."""
    words = len(phrase.split())
    pieces = F.split(pad, f" {phrase}(?= )", -1)
    spaces = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + words)
    none = F.array().cast("array<int>")
    return F.when(pad.contains(f" {phrase} "), F.transform(running_sums(spaces), lambda end: (end - words).cast("int"))).otherwise(none)


def token_order(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> list[str]:
    """All template tokens by the number of documents holding them, rarest first, ties by name. One row comes back, whatever the input."""
    tokens = sorted({t for _, text in templates for t in template_tokens(text)})
    row = docs.select(padded(F.col(text_col)).alias("p")).agg(*(F.count_if(F.col("p").contains(f" {t} ")).alias(f"t{k}") for k, t in enumerate(tokens))).first()
    count = {t: row[f"t{k}"] or 0 for k, t in enumerate(tokens)}
    return sorted(tokens, key=lambda t: (count[t], t))


def holds(token: str):
    return lambda run: F.array_contains(run, token)


def best_run(words: Column, own: Column, label: str, size: int) -> Column:
    """Most distinct tokens of a template in ``size`` words in a row; runs that start at a token suffice. Null if no run holds what it must."""
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(own, w), i)), lambda i: i.isNotNull())
    runs = F.transform(starts, lambda i: F.array_intersect(own, F.slice(words, i + 1, F.lit(size))))
    for token in MUST.get(label, ()):
        runs = F.filter(runs, holds(token))
    return F.array_max(F.transform(runs, F.size))


def block_matches(text: Column, pad: Column, order: list[str], percent: int = CONTAINMENT_PERCENT, templates=TEMPLATES, paragraphs: bool = False) -> Column:
    """All (block, template) pairs of a text that meet the threshold; blocks are its lines, from 0, or its paragraphs.

    A template may stand wrapped in a paragraph, so its lines are joined; then the tokens must stand within a run of
    SPAN times the template's words, as a long paragraph holds many words far apart.
    """
    rank = {t: k for k, t in enumerate(order)}
    sets = [sorted(template_tokens(t), key=rank.__getitem__) for _, t in templates]
    heads = [s[: len(s) - need(len(s), percent) + 1] for s in sets]
    gate = None
    for token in sorted({t for h in heads for t in h}):
        hit = pad.contains(f" {token} ")
        gate = hit if gate is None else gate | hit
    words = F.array(*map(F.lit, order))
    none = F.array().cast(MATCHES)

    def met(k: int, words_: Column, at: Column) -> Column:
        (label, template), tokens = templates[k], sets[k]
        m, least = len(tokens), need(len(tokens), percent)
        own = F.array(*map(F.lit, tokens))
        size = SPAN * len(re.sub(GAPS, " ", template.lower()).split())
        row = lambda n: F.struct(at.alias("block"), F.lit(k).alias("template"), F.lit(label).alias("label"), n.alias("shared"), (n / F.lit(m)).alias("score"))
        near = F.arrays_overlap(words_, F.array(*map(F.lit, heads[k]))) & (F.size(F.array_intersect(words_, own)) >= least)
        return F.when(near, F.transform(F.filter(F.array(best_run(words_, own, label, size)), lambda n: n >= least), row)).otherwise(none)

    def of_paragraph(block: Column, at: Column) -> Column:
        split = F.split(F.trim(F.regexp_replace(block, GAPS, " ")), " ")
        return F.flatten(F.transform(F.array(split), lambda ws: F.concat(*(met(k, ws, at) for k in range(len(templates))))))

    def of_block(block: Column, at: Column) -> Column:
        held = F.array_intersect(words, F.split(padded(block), " "))  # in global order

        def of_held(h: Column) -> Column:
            made = []
            for k, ((label, _), tokens, head) in enumerate(zip(templates, sets, heads, strict=True)):
                m, least = len(tokens), need(len(tokens), percent)
                own = F.array(*map(F.lit, tokens))
                first = F.get(F.array_intersect(h, F.array(*map(F.lit, head))), F.lit(0))
                bound = F.least(m - F.array_position(own, first) + 1, F.size(h) - F.array_position(h, first) + 1)
                shared = F.size(F.array_intersect(h, own))
                near = (F.size(h) >= least) & F.arrays_overlap(h, F.array(*map(F.lit, head)))
                row = F.struct(at.alias("block"), F.lit(k).alias("template"), F.lit(label).alias("label"), shared.alias("shared"), (shared / F.lit(m)).alias("score"))
                made.append(F.when(near, F.when(bound >= least, F.when(shared >= least, row))))
            return F.filter(F.array(*made), lambda r: r.isNotNull())

        return F.flatten(F.transform(F.array(held), of_held))

    blocks = F.split(F.translate(text, UPPER, LOWER), BREAK, -1) if paragraphs else F.split(text, "\n", -1)
    found = F.flatten(F.transform(blocks, of_paragraph if paragraphs else of_block)).cast(MATCHES)
    return F.when(gate, found).otherwise(none) if gate is not None else none


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = CONTAINMENT_PERCENT, phrases=BASE_PHRASES, templates=TEMPLATES, paragraphs: bool = False) -> DataFrame:
    """(id, n_words, places, matches) of every row: where base phrases stand, and the blocks (lines or paragraphs) that match templates.

    Null and empty texts have no words, places or matches; repeated rows repeat. Only the two columns named are read.
    """
    order = token_order(docs, text_col, templates)
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("p", padded(text))
    place = lambda label: lambda at: F.struct(at.alias("start"), F.lit(label).alias("label"))
    places = [F.transform(phrase_starts(F.col("p"), phrase), place(label)) for phrase, label in phrases]
    return rows.select("id", word_count(F.col("p")).alias("n_words"), F.concat(*places).alias("places"), block_matches(text, F.col("p"), order, percent, templates, paragraphs).alias("matches"))


def license_blocks(docs: DataFrame, **options) -> DataFrame:
    """One row per text block and template that it meets: id, block, template, label, shared, score."""
    return scan_licenses(docs, **options).select("id", F.explode("matches").alias("m")).select("id", "m.*")
