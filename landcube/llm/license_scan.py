"""License scans: phrases, and an exact set-similarity join with templates.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in
lower case; a phrase stands where its words stand consecutively. The join finds
every text block that holds at least ``threshold`` of a template's words. A block
is the set of words of a line and of those that follow it, in whatever lines, up to
one word less than the template has, so that wrapped notices are found:

* template words are ordered by their frequency in the whole corpus, rare first;
* prefix filter: of a template with n words that needs o of them, a matching
  block holds one of the n - o + 1 rarest, so only blocks with such a word are
  looked at;
* length filter: a block has at least o different words;
* positional filter: past the first common word both the template and the block
  have to hold words enough for what is still missing;
* what is left is counted exactly.

The templates' index and their word frequencies are bounded by the templates,
whatever the corpus, so the join stands inside each row and shuffles nothing. All
of it is DataFrame functions. Null text counts as
empty: no words, no labels (empty strings), null places, score 0. Repeated rows
are each answered; a null ``doc_id`` is passed on; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and labels (fixed values of the contract).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: What a word is made of, upper case included: the split needs no lowered copy.
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Label and text of each template.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "available under the Creative Commons Attribution-ShareAlike License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("reserved", "Copyright, all rights reserved"),
]
THRESHOLD = 0.8


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """All words of a text, in order: what stands between other characters. One
    split costs a fifth of a match per word."""
    return F.array_remove(F.split(text, f"{APART}+"), "")


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def _phrase(phrase: str) -> str:
    """Pattern of a phrase's words with anything but words between and around."""
    apart = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    each = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in phrase.split()]
    return f"(?<!{LETTER})" + apart.join(each) + f"(?!{LETTER})"


def phrase_places(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with n_words, n_base, first_word, last_word, base_labels.

    Only texts with a phrase pay for word numbers.
    """
    text = F.coalesce("text", F.lit(""))
    counts = {p: f"_n{i}" for i, p in enumerate(PHRASES)}
    out = docs.withColumn("n_words", F.size(words(text)).cast("long"))
    any_ = "(?:" + "|".join(_phrase(p) for p in PHRASES) + ")"
    hit = text.rlike(any_)
    out = out.withColumn("_hit", hit)
    for p, c in counts.items():
        out = out.withColumn(c, F.when(F.col("_hit"), F.regexp_count(text, F.lit(_phrase(p)))).otherwise(0).cast("long"))
    # words before the first and before the last phrase
    before = lambda some: F.regexp_count(F.regexp_extract(text, f"(?s)^({some})(?:{any_})", 1), F.lit(f"{LETTER}+")).cast("long")
    return out.withColumns({
        "n_base": sum((F.col(c) for c in counts.values()), F.lit(0)).cast("long"),
        "first_word": F.when(F.col("_hit"), before(".*?")),
        "last_word": F.when(F.col("_hit"), before(".*")),
        "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(PHRASES[p])) for p, c in counts.items()))))),
    }).drop("_hit", *counts.values())


def vocabulary(templates) -> list[str]:
    return sorted({w for _, text in templates for w in _words_of(text)})


def frequencies(docs: DataFrame, templates) -> dict[str, int]:
    """In how many texts each template word stands: a row per template word."""
    known = F.array(*map(F.lit, vocabulary(templates)))
    seen = docs.select(F.explode(F.array_intersect(words(ascii_lower(F.coalesce("text", F.lit("")))), known)).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in seen.collect()}


def index(templates, frequency: dict[str, int], threshold: float = THRESHOLD) -> list[dict]:
    """Each template's words, rare first, how many of them it needs, and its prefix."""
    out = []
    for label, text in templates:
        all_ = sorted(set(_words_of(text)), key=lambda w: (frequency.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(all_) - 1e-9))
        out.append({"label": label, "all": all_, "need": need, "words": len(_words_of(text)), "prefix": all_[: len(all_) - need + 1]})
    return out


def matches(text: Column, found: list[dict], frequency: dict[str, int]) -> Column:
    """array<struct<label, containment>> of the templates that the blocks of
    ``text`` meet. The bounded index stands inside the expression, so that the
    join needs no shuffle and knows no hot key."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    order = strings(sorted({w for t in found for w in t["all"]}, key=lambda w: (frequency.get(w, 0), w)))
    table = F.array(*(F.struct(F.lit(t["label"]).alias("label"), strings(t["all"]).alias("all"), F.lit(t["need"]).alias("need"), F.lit(t["words"]).alias("words"), strings(t["prefix"]).alias("prefix")) for t in found))
    rare = "(?i)(?<!" + LETTER + ")(?:" + "|".join(sorted({w for t in found for w in t["prefix"]})) + ")(?!" + LETTER + ")"
    reach = max(t["words"] for t in found) - 1  # words that a wrapped template can have past a block's first line
    # only texts with such a word are split; a line without words takes no part
    head = f"^{APART}*+(?:{LETTER}++{APART}*+){{0,{reach}}}"
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  evaluates value once, for all lines

    def starts(near):
        # a block begins at most ``reach`` lines before a rare word
        return F.filter(F.transform(near, lambda _, i: F.when(F.exists(F.slice(near, i + 1, F.lit(reach + 1)), lambda x: x), i)), lambda i: i.isNotNull())

    def block_of(ls, i):
        after = F.transform(F.slice(ls, i + 2, F.lit(reach)), lambda line: F.regexp_extract(line, head, 0))
        return F.struct(
            F.array_intersect(order, words(ascii_lower(F.get(ls, i)))).alias("own"),
            F.slice(words(ascii_lower(F.array_join(after, "\n"))), 1, reach).alias("after"))

    # only texts with such a word are split; a line without words takes no part
    ls = F.when(text.rlike(rare), F.filter(F.split(text, "\n"), lambda line: line.rlike(LETTER))).otherwise(F.array().cast("array<string>"))
    blocks = once(ls, lambda ls: F.transform(once(F.transform(ls, lambda line: line.rlike(rare)), starts), lambda i: block_of(ls, i)))
    # ``whole``: the block's template words for the longest template, rare first
    sets = F.transform(blocks, lambda b: b.withField("whole", F.array_intersect(order, F.concat(b["own"], b["after"]))))
    sets = F.filter(sets, lambda b: F.size(b["whole"]) >= min(t["need"] for t in found))
    common = lambda b, t: F.size(F.array_intersect(t["all"], F.concat(b["own"], F.slice(b["after"], F.lit(1), t["words"] - 1))))

    def meets(block, t):
        first = F.get(F.array_intersect(t["prefix"], block), F.lit(0))  # prefix filter: null if there is none
        left = F.least(F.size(t["all"]) - F.array_position(t["all"], first), F.size(block) - F.array_position(block, first))
        return (
            (F.size(block) >= t["need"])
            & F.arrays_overlap(t["prefix"], block)
            & (left + 1 >= t["need"])
            & (F.size(F.array_intersect(t["all"], block)) >= t["need"])
        )

    return F.flatten(F.transform(sets, lambda b: F.transform(
        F.filter(table, lambda t: meets(b["whole"], t) & (common(b, t) >= t["need"])),
        lambda t: F.struct(t["label"].alias("label"), (common(b, t) / F.size(t["all"])).alias("containment")))))


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score): ``labels`` adds the templates' to the base ones; the score is 1 with
    a phrase and else the highest containment found."""
    templates = TEMPLATES if templates is None else templates
    frequency = frequencies(docs, templates) if templates else {}
    out = phrase_places(docs.select("doc_id", "text"))
    none = F.array().cast("array<struct<label:string,containment:double>>")
    out = out.withColumn("_met", matches(F.coalesce("text", F.lit("")), index(templates, frequency, threshold), frequency) if templates else none)
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("_met", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("_met", lambda m: m["containment"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"))
