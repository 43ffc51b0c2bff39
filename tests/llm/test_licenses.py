from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tablewright.llm import licenses as module
from tablewright.llm.catalog import QUERIES, SQL
from tests.comparison import connect, differences
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def expected(row, templates=module.TEMPLATES, threshold=0.8):
    text = (row[1] or "").translate(LOWER)
    words = WORD.findall(text)
    places, base = [], set()
    for phrase, label in module.PHRASES.items():
        own = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += found
        base |= {label} if found else set()
    more, score = set(), 0.0
    for block in re.split(module.BREAK, text):
        have = set(WORD.findall(block))
        for template in templates:
            want, needs, bars = (set(re.findall("[0-9a-z]+", x.lower())) for x in template[1:])
            if len(have & want) >= math.ceil(threshold * len(want) - 1e-9) and needs <= have and not bars & have:
                more.add(template.label)
                score = max(score, len(have & want) / len(want))
    first, last = (min(places), max(places)) if places else (None, None)
    return (row[0], len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score)


TEXTS = [
    "Released under the MIT License.",
    "released UNDER the\nMIT-license; Apache\t\tLicense and gnu general public license. mit license",
    "cc by nc 4.0 licensed under it\nCC BY",
    "xmit license, mit licenses, émit license, mit éicense, the apache",
    "GNU General  Public -- License version 3 is what this work is licensed under the",
    "Kelvin mit license İ MIT LICENSE",
    "license license mit mit license license",
    "permission is granted free of charge to any person obtaining a copy of this software",
    "All rights reserved. Copyright; no part of this may be reproduced without\n",
    "GPL\nthis work is licensed under the gnu general public license, version 3, " * 3,
]


WRAPPED = """# Copyright (c) 2020
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
# Something else"""
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy was not distributed */"
MIT = """MIT

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
CONFUSED = [
    (WRAPPED, "bsd"),
    (MPL, "mpl"),
    (MIT.replace("\n", "\r\n"), "mit"),
    ("Released under the BSD License", "bsd"),
    ("Released under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation, either version 3 of the License or any later version", "lgpl"),
    ("Released today. It is under no license. The MIT has a campus.", ""),
]


def test_wrapped_statements_and_licenses_alike(spark):
    rows = [(k, text, "", "", 0) for k, (text, _) in enumerate(CONFUSED)]
    found = {x.doc_id: x.labels for x in module.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: labels for k, (_, labels) in enumerate(CONFUSED)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_texts(spark, threshold):
    rows = [(k, text, "", "", 0) for k, text in enumerate(TEXTS + [x for x, _ in CONFUSED])] + awkward_rows()
    rows += [(3, TEXTS[0], "", "", 0), (None, TEXTS[0], "", "", 0)]
    found = module.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=threshold)
    assert Counter(map(tuple, found.collect())) == Counter(expected(row, threshold=threshold) for row in rows)


def test_empty_table_and_clashing_columns(spark):
    assert module.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS mark", "2 AS words", "3 AS n_words", "4 AS score", "5 AS label")
    assert module.scan_licenses(docs).count() == len(awkward_rows())


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, TEXTS[0], "", "", 0)], SCHEMA)
    module.scan_licenses(docs).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


@needs_tables
def test_query(spark):
    with connect(FOLDER) as database:
        assert differences(QUERIES["op9_license_scan"](spark, FOLDER), database, SQL["op9_license_scan"]) == []
