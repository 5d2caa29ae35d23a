"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template is a set of words. A text's blocks for a template are the windows of twice its length that begin with one of
its words; any other window has no more of its words than the block that begins with the window's first. Words are ordered by
their document frequency over the corpus, rarest first; a block that contains a share ``threshold`` of a template holds
one of the template's ``n - ceil(threshold * n) + 1`` rarest words (its prefix). Only blocks that reach such a word are
looked at; a block too short (length filter), or without enough words from the matched one on in the common order
(positional filter), is dropped, and containment is then counted exactly.

The base is kept apart: places where a fixed phrase's words stand one after the other.

Templates become literals of the plan: they are taken in groups of TEMPLATES, each a pass over documents' words.
Defined results: null and empty texts have no words and score 0; repeated rows get a row each; empty tables give no
rows (documents) or base results only (templates). Ids are integers (others raise Spark's cast error); a text may be of any length; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, TEMPLATES = 0.8, 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices, as (label, text).
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)


def _words(text: Column) -> Column:
    """Words after lower-casing; lower() moves no character into or out of a word, nor other ones to a phrase's letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def template_words(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


def phrase_starts(w: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after the other."""
    parts = phrase.split(" ")
    last = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == parts[-1])
    before = lambda i: [F.get(w, i - (len(parts) - 1 - k)) == parts[k] for k in range(len(parts) - 1)]

    def ok(i: Column) -> Column:
        out = i >= len(parts) - 1
        for c in before(i):
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.transform(F.filter(last, ok), lambda i: i - (len(parts) - 1))


def scan_licenses(docs: DataFrame, templates: tuple = NOTICES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, base: array of (label, start), matches: array of (label, block start, block end, containment)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = [(label, len(w), sorted(set(w))) for label, t in templates if (w := template_words(t))]
    vocabulary = sorted({x for _, _, s in sets for x in s})
    rarity: dict[str, int] = {}
    if vocabulary:
        seen = docs.select(F.explode(F.array_intersect(_words(F.col("text")), _strings(vocabulary))).alias("word"))
        rarity = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the templates' words
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (rarity.get(w, 0), w)))}
    worded = docs.select("doc_id", _words(F.col("text")).alias("w"))
    named = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start"))
    base = [F.transform(phrase_starts(F.col("w"), p), named(label)) for p, label in PHRASES.items()]
    none = "array<struct<label:string,start:long>>"
    lasts = sorted({p.split(" ")[-1] for p in PHRASES})
    found = F.when(F.arrays_overlap("w", _strings(lasts)), F.concat(*base)).otherwise(F.array().cast(none))
    kind = "array<struct<label:string,start:long,end:long,containment:double>>"
    matches = []
    for at in range(0, len(sets), TEMPLATES):
        some = sets[at : at + TEMPLATES]
        rows, prefixes = [], set()
        for label, length, words in some:
            ranked = sorted(words, key=order.__getitem__)
            need = math.ceil(threshold * len(ranked) - 1e-9)
            prefix = ranked[: len(ranked) - need + 1]
            prefixes.update(prefix)
            rows.append(F.struct(F.lit(label).alias("label"), F.lit(length).alias("length"), F.lit(need).alias("need"), _strings(prefix).alias("prefix"), _strings(ranked).alias("words")))
        looked = F.flatten(F.transform(F.array(*rows), _blocks))
        matches.append(F.when(F.arrays_overlap("w", _strings(sorted(prefixes))), looked).otherwise(F.array().cast(kind)).cast(kind))
    every = F.concat(*matches) if matches else F.array().cast(kind)
    return worded.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("base"), every.alias("matches"))


def _blocks(t: Column) -> Column:
    """The blocks of column w that reach the need of template t, with their containment."""
    w = F.col("w")
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(t["prefix"], F.get(w, i)))
    around = F.transform(places, lambda p: F.sequence(F.greatest(p - t["length"] * 2 + 1, F.lit(0)), p))
    blocks = F.filter(F.array_distinct(F.flatten(around)), lambda b: F.array_contains(t["words"], F.get(w, b)))
    blocks = F.filter(blocks, lambda b: F.size(w) - b >= t["need"])  # length filter

    def judged(b: Column) -> Column:
        own = F.array_intersect(t["words"], F.slice(w, b + 1, t["length"] * 2))  # in the template's (common) order
        return F.struct(t["label"].alias("label"), b.cast("long").alias("start"), F.least(b + t["length"] * 2, F.size(w)).cast("long").alias("end"), own.alias("own"))

    held = F.transform(blocks, judged)
    # Positional filter: from the first prefix word of the block on, the template must still have as many words as it needs.
    held = F.filter(held, lambda h: (F.size(h["own"]) > 0) & (F.size(t["words"]) - F.array_position(t["words"], F.get(h["own"], F.lit(0))) + 1 >= t["need"]))
    held = F.filter(held, lambda h: F.size(h["own"]) >= t["need"])
    return F.transform(held, lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), h["end"].alias("end"), (F.size(h["own"]) / F.size(t["words"])).alias("containment")))


def license_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of what ``scan_licenses`` returns."""
    base, matches = F.col("base"), F.col("matches")
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["start"])).alias("first_word"), F.array_max(F.transform(base, lambda b: b["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(base, matches).alias("labels"), F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
