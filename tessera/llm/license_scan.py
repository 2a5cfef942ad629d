"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then the nearest ancestor directory.

Units of a file are its lines and its paragraphs (lines up to one without words,
so a comment block is cut like the text in it). Every unit is compared with short
notices, standard headers and opening paragraphs of licences. A unit can only
reach the threshold of a template if it holds one of the template's heavier
terms: those that are left when the lightest, as many as together stay below the
threshold, are set aside. Of the units with such a term, those stay that could
reach a threshold if every term whose frequency is not at hand weighed as little
as it can. These are few, even where a notice is very common: the paragraphs
around it are too long. Each different one is taken apart once and joined with
the true weights.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, hot_keys, materialize, salted_join, spark_of, split_words
from tessera.llm.decontaminate import NOT_WORD


class Template(NamedTuple):
    """rank: a licence that holds the text of another, as BSD-3 does of BSD-2, ranks above it."""

    license: str
    text: str
    threshold: float = 0.7
    rank: int = 1


# Identifiers and the names by which notices call the licences.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD-style license (2-Clause BSD License)", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD-style license (3-Clause BSD License)", "3-Clause BSD License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
}
NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Use of this source code is governed by the {}.")
# First words of licences and their standard headers, as published.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
PARAGRAPHS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", GNU.format("General Public License", "2")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", GNU.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", GNU.format("Lesser General Public License", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPDX_THRESHOLD = 0.9


def standard_templates() -> list[Template]:
    """Notices of every name, SPDX lines of every identifier and its forms, headers and opening paragraphs."""
    out = [Template(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    forms = {k: (k, f"{k}-only", f"{k}-or-later") if "GPL" in k else (k,) for k in NAMES}
    out += [Template(k, f"SPDX-License-Identifier: {form}", SPDX_THRESHOLD) for k, own in forms.items() for form in own]
    out += [Template(k, text, 0.7, int(k != "BSD-2-Clause")) for k, text in PARAGRAPHS]
    return out


LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
#: Between two paragraphs: one or more lines without a word.
BETWEEN = "\\n(?:[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\n)+"


def terms(c: Column) -> Column:
    return split_words(ascii_lower(c), NOT_WORD)


def _python_terms(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c >= "\x80" or c.isalnum() else " " for c in low).split()


def units(text: Column) -> Column:
    """The lines of a text, then its paragraphs of two lines or more."""
    return F.concat(F.split(text, "\n", -1), F.filter(F.split(text, BETWEEN, -1), lambda p: F.contains(p, F.lit("\n"))))


def idf_of(df: int, n_docs: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1


def template_vectors(df: dict[str, int], n_docs: int, templates: list[Template]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    vectors = []
    for t in templates:
        raw = {x: n * idf_of(df.get(x, 0), n_docs) for x, n in sorted(Counter(_python_terms(t.text)).items())}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({x: w / norm for x, w in raw.items()})
    return vectors


def prefix_terms(vector: dict[str, float], threshold: float) -> list[str]:
    """Terms of a unit vector one of which a text must hold for a cosine of threshold: the rest together are shorter than that."""
    light, out = 0.0, []
    for t, x in sorted(vector.items(), key=lambda e: (e[1], e[0])):
        light += x * x
        if light >= threshold * threshold * (1 - 1e-9):
            out.append(t)
    return out


#: Terms beside the templates' own whose frequencies are told to every task, at most.
FREQUENT = 2000
#: Cosines are rounded to six digits before they are held against a threshold.
SLACK = 1e-5


def frequencies(df: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """df of the terms of vocabulary and of those with over a FREQUENT-th of all counts, of which there are fewer than FREQUENT; the df that no other term exceeds."""
    most = (df.agg(F.sum("df")).first()[0] or 0) // FREQUENT
    told = df.where(F.col("term").isin(*sorted(vocabulary)) | (F.col("df") > most)).collect()
    return {t: 0 for t in vocabulary} | {r["term"]: r["df"] for r in told}, most


def pulls(vectors: list[dict[str, float]], thresholds: list[float]) -> dict[str, float]:
    """By term, the most that its weight is in a vector, as a multiple of that vector's threshold."""
    out: dict[str, float] = {}
    for v, threshold in zip(vectors, thresholds, strict=True):
        for t, w in v.items():
            out[t] = max(out.get(t, 0.0), w / max(threshold - SLACK, SLACK))
    return out


def near(units: DataFrame, pull: dict[str, float], idf: dict[str, float], least: float) -> DataFrame:
    """units (with terms, an array) without those whose cosine stays below the threshold of every template.

    A dot product is at most the sum of the terms' weights by their pulls, a
    norm at least that of the terms if those not in idf, which has those of
    pull, have an idf of least, the others of idf one rounded down to halves,
    and if terms beside those of pull count by their first powers.
    """
    floors: dict[float, list[str]] = {}
    for t in sorted(idf.keys() - pull.keys()):
        floors.setdefault(math.floor(2 * idf[t]) / 2, []).append(t)
    own = sorted(pull)

    def of_own(values: dict[str, float], t: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(y) for x in own for y in (x, values[x])]), t)

    def square(t: Column) -> Column:
        out = F.when(t.isin(own), 0.0)
        for x, found in floors.items():
            out = out.when(t.isin(found), x * x)
        return out.otherwise(least * least)

    # generated columns are not computed again inside the filter or its lambdas
    cut = units.select("*", F.inline(F.array(F.struct(F.filter("terms", lambda t: t.isin(own)).alias("__own"), F.aggregate("terms", F.lit(0.0), lambda a, t: a + square(t)).alias("__rest")))))
    weighed = F.transform(F.array_distinct("__own"), lambda t: F.struct((of_own(idf, t) * F.size(F.filter("__own", lambda x: x == t))).alias("x"), of_own(pull, t).alias("pull")))
    cut = cut.select(*units.columns, "__rest", F.inline(F.array(F.struct(weighed.alias("__own")))))
    dot = F.aggregate("__own", F.lit(0.0), lambda a, c: a + c["x"] * c["pull"])
    squares = F.aggregate("__own", F.col("__rest"), lambda a, c: a + c["x"] * c["x"])
    return cut.where(dot >= F.sqrt(squares)).select(*units.columns)


def matches(files: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """__k1, __k2, license, similarity: the best template of each text of files (__k1, __k2, text) that reaches its threshold.

    A term's idf is taken over all files. Templates of a higher rank go first,
    then the more similar, then the first identifier.
    """
    templates = templates or standard_templates()
    spark = spark_of(files)
    vocabulary = {t for x in templates for t in _python_terms(x.text)}
    df = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = materialize(df, "license-frequencies")
    told, most = frequencies(df, vocabulary)
    n_docs = files.count()
    vectors = template_vectors(told, n_docs, templates)
    triggers = sorted({t for v, x in zip(vectors, templates, strict=True) for t in prefix_terms(v, x.threshold)})
    pull = pulls(vectors, [x.threshold for x in templates])
    unit = files.select("__k1", "__k2", F.explode(units(F.col("text"))).alias("line"))
    unit = unit.select("__k1", "__k2", terms(F.col("line")).alias("terms")).where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in triggers])))
    unit = near(unit, pull, {t: idf_of(n, n_docs) for t, n in told.items()}, idf_of(most, n_docs)).select("__k1", "__k2", F.array_join("terms", " ").alias("words"))
    unit_keys = ["__u1", "__u2"]
    unit = unit.select("*", F.xxhash64("words").alias("__u1"), F.xxhash64(F.lit(1), "words").alias("__u2"))
    unit = materialize(unit.groupBy("__k1", "__k2", *unit_keys).agg(F.any_value("words").alias("words")), "license-units")
    different = unit.groupBy(*unit_keys).agg(F.any_value("words").alias("words"))
    counted = different.select(*unit_keys, F.explode(F.split("words", " ")).alias("term")).groupBy(*unit_keys, "term").agg(F.count("*").alias("n"))
    counted = materialize(counted, "license-terms")
    sizes = materialize(counted.groupBy("term").agg(F.count("*").alias("n")), "license-sizes")
    counted = salted_join(counted, df, ["term"], hot_keys(sizes, ["term"], "n"), F.xxhash64(*unit_keys))
    counted = materialize(counted.select(*unit_keys, "term", (F.col("n") * (F.log((F.lit(1.0) + n_docs) / (1 + F.col("df"))) + 1)).alias("x")), "license-weights")
    rows = [(no, x.license, x.rank, x.threshold, t, w) for no, (v, x) in enumerate(zip(vectors, templates, strict=True)) for t, w in v.items()]
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, rank int, threshold double, term string, weight double"))
    norms = counted.groupBy(*unit_keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(weights, "term").groupBy(*unit_keys, "template", "license", "rank", "threshold").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, unit_keys).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= F.col("threshold"))
    best = F.min(F.struct((-F.col("rank")).alias("above"), (-F.col("similarity")).alias("less"), "license")).alias("best")
    of_unit = materialize(cosine.groupBy(*unit_keys).agg(best), "license-cosines")
    sizes = materialize(unit.groupBy(*unit_keys).agg(F.count("*").alias("n")), "license-copies")
    found = salted_join(unit.drop("words"), of_unit, unit_keys, hot_keys(sizes, unit_keys, "n"), F.xxhash64("__k1", "__k2"))
    found = found.groupBy("__k1", "__k2").agg(F.min("best").alias("best"))
    return found.select("__k1", "__k2", F.col("best.license").alias("license"), (-F.col("best.less")).alias("similarity"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """array<struct<depth, folder>>: the folder itself and all above it, the root ('') at depth 0."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")))


def scan(files: DataFrame, templates: list[Template] | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files with license, similarity, basis and license_dir.

    basis: `header` for a notice of the file's own, wherever it stands in it,
    `inherited` for that of the nearest directory above it, its own included,
    with a licence file (by its name) that matches a template, else null. A
    directory with several takes the most similar, then the first identifier.
    Null texts have no notice; null paths lie in the root; repeated rows stay
    rows; empty tables give none; clashing names of files are replaced; names
    that begin with two underscores are reserved.
    """
    base = files.drop(*({"license", "similarity", "basis", "license_dir"} & set(files.columns)))
    path = F.coalesce(F.col(path_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.regexp_extract(path, "[^/]*$", 0).rlike(LICENSE_FILE)
    keyed = base.select("*", F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"), directory(path).alias("__dir"), named.alias("__named"))
    own = materialize(matches(keyed.select("__k1", "__k2", text.alias("text")), templates), "license-matches")
    own = own.select("__k1", "__k2", F.col("license").alias("__license"), F.col("similarity").alias("__similarity"))
    by_dir = keyed.where("__named").select("__k1", "__k2", "__dir").distinct().join(own, ["__k1", "__k2"])
    by_dir = by_dir.groupBy("__dir").agg(F.min(F.struct((-F.col("__similarity")).alias("less"), "__license")).alias("best"))
    by_dir = by_dir.select(F.col("__dir").alias("__folder"), F.col("best.__license").alias("__from"), (-F.col("best.less")).alias("__from_similarity"))
    # what is inherited depends on the directory alone
    above = keyed.select("__dir").distinct().select("__dir", F.inline(ancestors(F.col("__dir")))).withColumnRenamed("folder", "__folder").join(by_dir, "__folder")
    nearest = above.groupBy("__dir").agg(F.max_by(F.struct("__folder", "__from", "__from_similarity"), "depth").alias("__near")).select("__dir", "__near.*")
    found = keyed.join(own, ["__k1", "__k2"], "left").join(materialize(nearest, "license-dirs"), "__dir", "left")
    return found.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce("__license", "__from").alias("license"),
        F.coalesce("__similarity", "__from_similarity").alias("similarity"),
        F.when(F.col("__license").isNotNull(), "header").when(F.col("__from").isNotNull(), "inherited").alias("basis"),
        F.when(F.col("__license").isNull(), F.col("__folder")).alias("license_dir"),
    )
