"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

DataFrame functions only. A block is a sentence: what lies between ends of sentences and lines
without words, so a statement may be wrapped over lines. A template is a sentence of a license
statement. A block meets it if it has at least ``threshold`` of the template's distinct words,
all of the words that tell it from others (``needs``) and none that would make it another
(``bars``). The join finds all such pairs:

* Words are ordered by how often the whole corpus has them, rarest first.
* Prefix filter: of a template with n words, k = ceil(threshold * n) must be there, so one
  of its n - k + 1 rarest must. Only blocks with such a word are taken apart, and joined
  on it with the templates it is a prefix word of.
* Length filter: a block needs k distinct words of templates.
* Positional filter: what lies before and after the joined word in both orders must suffice for k.
* Pairs that remain are compared, and the words that tell templates apart looked for.

Templates are a short list given by the caller, so what is made of them is small by
construction and broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.places import Scratch, quoted

# Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    """A sentence of a license statement; words that a block must and must not have, too."""

    label: str
    statement: str
    needs: str = ""
    bars: str = ""


_OTHER_GNU = "lesser library affero"
_OTHER_CC = "sharealike share noncommercial commercial noderivatives noderivs derivatives"
# Sentences of published licenses and their notices; a label may have several.
TEMPLATES = (
    Template("gpl", "This work is licensed under the GNU General Public License version 3", "gnu general public", _OTHER_GNU),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gnu general public",
        _OTHER_GNU,
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
        "gnu lesser",
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gnu affero",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
        "apache",
    ),
    Template("mit", "Released under the MIT License", "mit license"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions",
        "permission granted charge",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "permission granted fee",
    ),
    Template("bsd", "Released under the BSD License", "bsd license"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "redistribution binary permitted",
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution binary permitted"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution", _OTHER_CC),
    Template(
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "commons attribution sharealike",
        "noncommercial commercial",
    ),
    Template(
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "commons attribution noncommercial",
        "sharealike noderivatives noderivs",
    ),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "waived copyright",
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    Template("proprietary", "No part of this work may be reproduced without prior written permission", "reproduced permission"),
)
THRESHOLD = 0.8

# Letters, digits and whatever is not ASCII; A-Z count as a-z.
_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# Between blocks: the end of a sentence, or of a paragraph.
BREAK = "[.!?][\"')\\]]*[\\x20\\x09-\\x0D]+|\\n[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_licenses(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] | None = None,
    templates: tuple[Template, ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id n_words n_base first_word last_word base_labels labels score``.

    ``n_base`` counts all places of all phrases, ``first_word`` and ``last_word`` are the
    smallest and largest first word of a place, null without one. ``labels`` has those of
    the phrases and of the templates that a block meets, ``score`` the largest share of a
    template that a block has, 0 where none is met. Null and empty texts have no words and
    no labels. Rows that repeat, and null identities, each keep their row.
    """
    phrases = PHRASES if phrases is None else phrases
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        quoted(identity).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("words")
    ).withColumn("mark", F.xxhash64("words"))
    met = scratch.keep(similar_blocks(rows, templates, threshold, scratch), "blocks")
    found = met.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("score")
    )
    base = phrase_places(rows, phrases)
    return base.join(found, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def phrase_places(rows: DataFrame, phrases: Mapping[str, str]) -> DataFrame:
    """``rows`` (``words``: the text) with ``n_words n_base first_word last_word base`` in its place.

    Phrases must not overlap each other: none may start inside another or itself.
    """
    one = {phrase: _phrase(phrase) for phrase in phrases}
    some = "|".join(one.values())
    text = F.col("words")
    places = F.regexp_extract_all(text, F.lit(some), F.lit(0))
    found = rows.withColumn("n_words", _count_words(text)).withColumn("places", F.when(text.rlike(some), places))
    has = F.col("places").isNotNull()
    parts = F.split(text, some, -1)
    labels = [F.when(has & text.rlike(pattern), F.lit(phrases[phrase])) for phrase, pattern in one.items()]
    return found.select(
        *(quoted(name) for name in rows.columns if name != "words"),
        "n_words",
        F.when(has, F.size("places")).otherwise(0).cast("long").alias("n_base"),
        F.when(has, _count_words(parts[0])).alias("first_word"),
        F.when(
            has, F.col("n_words") - _count_words(F.element_at(parts, -1)) - _count_words(F.element_at("places", -1))
        ).alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*labels))).alias("base"),
    )


def similar_blocks(rows: DataFrame, templates: tuple[Template, ...], threshold: float, scratch: Scratch) -> DataFrame:
    """``doc_id mark label score`` of all pairs of a block and a template that it meets."""
    spark = rows.sparkSession
    sets = [words_of(template.statement) for template in templates]
    telling = [(words_of(template.needs), words_of(template.bars)) for template in templates]
    vocabulary = sorted(set().union(*sets, *(words for pair in telling for words in pair)))
    text = F.col("words")
    counted = (
        rows.select(F.explode(F.regexp_extract_all(text, F.lit(_any_word(vocabulary)), F.lit(0))).alias("word"))
        .groupBy(_plain("word").alias("word"))
        .count()
    )
    # As many counts as templates have words.
    often = {row.word: row["count"] for row in counted.collect()}
    rank = {word: k for k, word in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    prefixes, lists = [], []
    for number, template in enumerate(templates):
        words = sorted(sets[number], key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        needs, bars = ([rank[word] for word in sorted(some)] for some in telling[number])
        lists.append((number, template.label, len(words), need, [rank[w] for w in words], needs, bars))
        prefixes += [(rank[word], number, place) for place, word in enumerate(words[: len(words) - need + 1])]
    rare = [word for word in vocabulary if rank[word] in {x[0] for x in prefixes}]
    index = spark.createDataFrame(prefixes, "rank int, template int, place int")
    known = spark.createDataFrame(lists, "template int, label string, size int, need int, ranks array<int>, needs array<int>, bars array<int>")
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    blocks = rows.where(text.rlike(_any_word(rare))).select("doc_id", "mark", F.explode(F.split(text, BREAK, -1)).alias("block"))
    # Template words of a block by rank: no other word can be shared.
    sorted_ranks = F.array_sort(
        F.array_distinct(F.transform(F.regexp_extract_all("block", F.lit(_any_word(vocabulary)), F.lit(0)), lambda w: ranks[_plain(w)]))
    )
    blocks = blocks.where(F.col("block").rlike(_any_word(rare))).select("doc_id", "mark", sorted_ranks.alias("have"))
    blocks = blocks.where(F.size("have") >= min(x[3] for x in lists))
    pairs = (
        blocks.select("doc_id", "mark", "have", F.posexplode("have").alias("at", "rank"))
        .join(F.broadcast(index), "rank")
        .join(F.broadcast(known), "template")
        .where(F.size("have") >= F.col("need"))
        .where(F.least("place", "at") + F.least(F.col("size") - F.col("place"), F.size("have") - F.col("at")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("have", "ranks"))
    met = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    met = met.where((F.size(F.array_except("needs", "have")) == 0) & ~F.arrays_overlap("bars", "have"))
    return met.select("doc_id", "mark", "label", (F.col("shared") / F.col("size")).alias("score")).distinct()


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def _plain(word: Column | str) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def words_of(statement: str) -> set[str]:
    return set(re.findall("[0-9a-z]+", statement.lower()))


def _bounded(pattern: str) -> str:
    return f"(?<![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])(?i:{pattern})(?![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])"


def _phrase(phrase: str) -> str:
    return _bounded(_GAP.join(map(re.escape, phrase.split())))


def _any_word(words: Iterable[str]) -> str:
    """Any of the words; those with the same first letter together, so that most places cost one look."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(re.escape(word[1:]))
    return _bounded("|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items()))
