import math
import re
from collections import Counter

import pytest
from tessera.llm import license_scan as S
from tessera.llm import oracles, queries

DDL = "doc_id long, path string, text string, license string"
TEMPLATES = S.standard_templates()


def scan(spark, rows):
    df = spark.createDataFrame([(i, p, t, "old") for i, (p, t) in enumerate(rows)], DDL)
    return {r["doc_id"]: r for r in S.scan(df).collect()}


def test_query_matches_sql(spark, duck, same):
    same(queries.op7_license_scan(spark, "/root/testdata/sf0.001"), duck, oracles.OP7)


PROSE = "\n".join(f"line {i} of some prose that a public person is free to read under the tree" for i in range(20))
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright 2019 The Authors

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

"""
NEITHER = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
HEADER = """#!/usr/bin/env python
# Copyright 2021 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0

import os
"""
LGPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Lesser General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}
"""


def test_customary_texts_are_recognised(spark):
    cases = [
        ("a/LICENSE", MIT, "MIT"), ("b/LICENSE", BSD, "BSD-2-Clause"), ("c/LICENSE", BSD + NEITHER, "BSD-3-Clause"), ("d/COPYING", GPL3, "GPL-3.0"), ("e/LICENSE", APACHE, "Apache-2.0"),
        ("f/x.py", HEADER, "Apache-2.0"), ("g/x.js", "// SPDX-License-Identifier: MIT\nlet a = 1", "MIT"), ("h/x.c", LGPL, "LGPL-3.0"), ("i/x.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
        ("j/x.txt", "SPDX-License-Identifier: Zlib", None), ("k/x.txt", PROSE, None), ("l/x.txt", "read the license before you use the software", None), ("m/x.txt", PROSE + "\n" + PROSE + "\nReleased under the MIT License.\n" + PROSE, "MIT"),
        ("n/x.txt", "the general public may use version 3 of the program", None), ("o/UNLICENSE", "This is free and unencumbered software released into the public domain.", "Unlicense"),
    ]
    out = scan(spark, [(p, t) for p, t, _ in cases])
    assert {p: out[i]["license"] for i, (p, _, _) in enumerate(cases)} == {p: k for p, _, k in cases}


def test_inheritance(spark):
    out = scan(spark, [
        ("LICENSE", MIT), ("a/x.txt", PROSE), ("a/b/LICENSE.md", PROSE + "\n\n" + APACHE), ("a/b/c/d.txt", PROSE), ("a/b/own.txt", PROSE + "\nreleased under the MIT license\n" + PROSE),
        (None, PROSE), ("z/COPYING", None), ("z/q.txt", None), ("a/b/c/d.txt", PROSE),
    ])
    assert (out[0]["license"], out[0]["basis"]) == ("MIT", "header")
    assert (out[1]["license"], out[1]["basis"], out[1]["license_dir"]) == ("MIT", "inherited", "")
    assert out[2]["license"] == "Apache-2.0" and out[2]["basis"] == "header"
    assert (out[3]["license"], out[3]["license_dir"]) == ("Apache-2.0", "a/b") and out[8]["license"] == "Apache-2.0"
    assert (out[4]["license"], out[4]["basis"]) == ("MIT", "header")
    assert out[5]["license"] == "MIT" and out[6]["license"] == "MIT" and out[7]["license_dir"] == ""


def brute(texts):
    words = S._python_terms
    df = Counter(x for t in texts for x in set(words(t or "")))
    idf = lambda x: math.log((1 + len(texts)) / (1 + df[x])) + 1
    vec = lambda s: {x: n * idf(x) for x, n in Counter(words(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(t, vec(t.text)) for t in TEMPLATES]
    out = []
    for text in texts:
        best = []
        lines = (text or "").split("\n")
        blocks = [b for b in re.split("\n(?:[^0-9A-Za-z\x80-\U0010ffff\n]*\n)+", text or "") if "\n" in b]
        for unit in lines + blocks:
            a = vec(unit)
            for t, b in known:
                c = round(sum(a[x] * b.get(x, 0) for x in a) / (norm(a) * norm(b)), 6) if a else 0
                if c >= t.threshold:
                    best.append((-t.rank, -c, t.license))
        out.append((min(best)[2], -min(best)[1]) if best else (None, None))
    return out


def test_prefix_filter_loses_no_match(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs += [t.text + " really" for t in TEMPLATES[::3]] + [t.text.split(" ", 1)[-1] for t in TEMPLATES[::4]] + ["license", "", None, "MIT", "under the", MIT, BSD + NEITHER, HEADER, LGPL]
    out = scan(spark, [(f"{i}.txt", t) for i, t in enumerate(docs)])
    for i, (k, c) in enumerate(brute(docs)):
        assert out[i]["license"] == k and (c is None or abs(out[i]["similarity"] - c) < 2e-6)


def test_paragraphs_around_a_common_notice_are_not_taken_apart(spark, monkeypatch):
    """Copies of a notice are compared once, and what is too long to match beside it meets no frequencies."""
    rows, materialize = {}, S.materialize

    def counting(df, name):
        rows[name] = (out := materialize(df, name)).count()
        return out

    monkeypatch.setattr(S, "materialize", counting)
    notice = "Licensed under the Apache License, Version 2.0."
    docs = [notice + "\n" + " ".join(f"w{i}x{j % 7} the of" for j in range(40)) for i in range(200)] + [PROSE] * 100
    docs += [notice.lower() + f"\nby author{i}" for i in range(5)]  # a paragraph that matches, but less than its first line
    out = scan(spark, [(f"{i}.txt", t) for i, t in enumerate(docs)])
    for i, (k, c) in enumerate(brute(docs)):
        assert out[i]["license"] == k and (c is None or abs(out[i]["similarity"] - c) < 2e-6)
    assert sum(r["license"] == "Apache-2.0" for r in out.values()) == 205
    assert rows["license-terms"] < 100


def test_bound_keeps_what_may_match_and_no_long_text(spark):
    many = [f"f{i}" for i in range(30)]
    df, thresholds = {"mit": 30, "under": 50, "often": 90, "common": 60} | dict.fromkeys(many, 90), [0.7, 0.9]
    vectors = S.template_vectors(df, 100, [S.Template("MIT", "under the MIT License"), S.Template("GPL-2.0", "the GPL, the license", 0.9)])
    idf = {t: S.idf_of(df.get(t, 0), 100) for t in {*df, *vectors[0], *vectors[1]}}
    texts = [f"{head} {' '.join(['often'] * i + ['common'] * j + [f'w{x}' for x in range(k)])}".split() for head in ("under the mit license", "the gpl the license", "mit mit license", "license", "gpl") for i in range(4) for j in range(3) for k in (0, 1, 2, 3, 60)]
    texts.append(["under", "the", "mit", "license", *many])
    rows = [(n, x) for n, x in enumerate(texts)]
    kept = {r["n"] for r in S.near(spark.createDataFrame(rows, "n int, terms array<string>"), S.pulls(vectors, thresholds), idf, S.idf_of(20, 100)).collect()}
    for n, words in rows:
        x = {t: c * idf.get(t, S.idf_of(20, 100)) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        if any(sum(x.get(t, 0) * w for t, w in v.items()) / norm >= least for v, least in zip(vectors, thresholds, strict=True)):
            assert n in kept
        assert "w50" not in words or n not in kept
    assert 20 < len(kept) < 200 and len(texts) - 1 in kept


@pytest.mark.parametrize("name", ["folder", "from_license", "license"])
def test_messy_documents(messy, empty, name):
    from pyspark.sql import functions as F

    rows = S.scan(messy.withColumn("path", F.concat("source", F.lit("/f"))))
    assert rows.count() == messy.count() and rows.columns.count(name) == 1
    assert S.scan(empty.withColumn("path", F.lit("x"))).count() == 0
