"""Licence scans: TF-IDF cosine of header lines to templates, then directory inheritance.

Every line of every whole text is a possible header, and so is every run of neighbouring lines: from
the start of each line as many tokens as a template has, so that wrapped notices, header blocks and
licence texts meet theirs. A unit's tokens weigh term frequency by
inverse document frequency, counted over all lines for the tokens of the templates; others take
the largest weight. A file's licence is the template of its best unit of at least min_cosine.
A licence file gives its licence to its directory; a file without one of its own inherits from
the nearest directory above that has one, found by joining the ancestors of each directory.

Before units are taken apart, two bounds drop those that can't reach min_cosine. The squared cosine
is at most the share of a template's squared weights whose tokens the unit has, so a unit (and a text)
must have one of the heaviest tokens, without which a template keeps less than that, and a text as many
of a template's tokens as its heaviest that reach that. And where the tokens
that templates know have the squared weights S in all, and there are o others of the largest
weight m, the squared cosine is at most S / (S + o m^2).

Defined cases: null and empty texts have no lines and may inherit; null paths stand in no
directory and inherit nothing; ties go to the template's name in order; rows that repeat a path
are one file with all their lines; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, table

# Notices as the licences ask them to be given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: More texts of the same licences: identifiers, header blocks, and full texts or the openings of long ones.
TEXTS = [
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
]


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _template_rows(templates: dict[str, str], spark) -> DataFrame:
    """template (its number), license, t and tf; the texts of the licences in templates stand beside them."""
    every = sorted(templates.items()) + [x for x in TEXTS if x[0] in templates]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(every)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(tokens(F.col("text"))).alias("t")).groupBy("template", "license", "t").agg(F.count("*").alias("tf"))


def headers(files: DataFrame, templates: dict[str, str] = TEMPLATES, min_cosine: float = 0.75) -> DataFrame:
    """path, license and cosine of the files with a header of their own. files: path, text."""
    spark = files.sparkSession
    terms = materialize(_template_rows(templates, spark), "license-terms")  # a row for each word of the templates: bounded by the parameter
    rows = terms.collect()
    vocabulary = sorted({r.t for r in rows})
    known = F.array(*map(F.lit, vocabulary))
    texts = files.where("path is not null").select("path", F.coalesce("text", F.lit("")).alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(tokens(F.col("line")).alias("ts")).where(F.size("ts") > 0).withColumn("shared", F.array_intersect("ts", known))
    counted = lines.select(F.explode(F.when(F.size("shared") > 0, F.array_append("shared", F.lit(""))).otherwise(F.array(F.lit("")))).alias("t"))
    df = materialize(counted.groupBy("t").agg(F.count("*").alias("df")), "license-df")  # at most one row for each template word, and the number of lines
    seen = {r.t: r.df for r in df.collect()}
    n = seen.get("", 0)
    top = F.lit(math.log(n + 1) + 1)
    weights = {t: math.log((n + 1) / (seen.get(t, 0) + 1)) + 1 for t in vocabulary}
    idf = spark.createDataFrame(sorted(weights.items()), "t string, idf double")
    masses: dict[int, dict[str, float]] = {}
    sizes: dict[int, int] = {}
    for r in rows:
        masses.setdefault(r.template, {})[r.t] = (r.tf * weights[r.t]) ** 2
        sizes[r.template] = sizes.get(r.template, 0) + r.tf
    heavy: set[str] = set()
    covered = []  # of each template: its size, where a text has as many of its tokens as the heaviest that reach min_cosine
    shared = F.col("has")
    for i, each in sorted(masses.items()):
        left, whole, count = sum(each.values()), sum(each.values()), 0
        for t, x in sorted(each.items(), key=lambda tx: (-tx[1], tx[0])):
            if left < min_cosine**2 * whole - 1e-9:
                break
            heavy.add(t)
            left -= x
        got = 0.0
        for x in sorted(each.values(), reverse=True):
            if got >= min_cosine**2 * whole - 1e-9:
                break
            got, count = got + x, count + 1
        covered.append(F.when(F.size(F.array_intersect(shared, F.array(*map(F.lit, sorted(each))))) >= count, F.lit(sizes[i])))
    heavy_words = F.array(*map(F.lit, sorted(heavy)))
    texts = texts.withColumn("has", F.array_intersect(tokens(F.col("text")), known)).where(F.arrays_overlap("has", heavy_words))
    texts = texts.select("path", "text", F.array_distinct(F.array_compact(F.array(*covered))).alias("lengths")).where(F.size("lengths") > 0)
    split = texts.select("path", "lengths", tokens(F.col("text")).alias("all"), F.filter(F.transform(F.split("text", "\n"), lambda x: F.size(tokens(x))), lambda n: n > 0).alias("sizes"))
    ends = F.aggregate("sizes", F.array(F.lit(0)).cast("array<int>"), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    split = split.select("path", "lengths", "all", "sizes", ends.alias("offsets"), F.array_max("lengths").alias("longest"))
    block = F.transform("sizes", lambda n, i: F.struct(n.alias("first"), F.slice("all", F.get("offsets", i) + 1, F.greatest("longest", n)).alias("ts")))
    starts = split.select("path", "lengths", F.posexplode(block).alias("pos", "b")).where(F.arrays_overlap("b.ts", heavy_words))
    ends = F.array_distinct(F.transform(F.array_append(F.filter("lengths", lambda x: x > F.col("b.first")), F.col("b.first")), lambda x: F.least(x, F.size("b.ts"))))
    units = starts.select("path", "pos", F.explode(ends).alias("len"), F.col("b.ts").alias("all")).select("path", "pos", "len", F.slice("all", 1, F.col("len")).alias("ts"))
    units = units.where(F.arrays_overlap("ts", heavy_words)).withColumn("shared", F.array_intersect("ts", known))
    weight = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item))
    tf = lambda t: F.size(F.filter("ts", lambda x: x == t))
    known_mass = F.aggregate("shared", F.lit(0.0), lambda acc, t: acc + F.pow(tf(t) * F.element_at(weight, t), F.lit(2.0)))
    others = F.size("ts") - F.aggregate("shared", F.lit(0), lambda acc, t: acc + tf(t))
    reach = known_mass >= min_cosine**2 * (known_mass + others * top * top) - 1e-9
    unit = ["path", "pos", "len"]
    possible = units.where(reach).select(*unit, F.explode("ts").alias("t"))
    weighed = possible.groupBy(*unit, "t").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "t", "left").select(*unit, "t", (F.col("tf") * F.coalesce("idf", top)).alias("w"))
    weighed = materialize(weighed, "license-weights")
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    model = terms.join(idf, "t", "left").select("template", "license", "t", (F.col("tf") * F.coalesce("idf", top)).alias("m"))
    lengths_of = model.groupBy("template", "license").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    dots = weighed.join(F.broadcast(model.drop("license")), "t").groupBy(*unit, "template").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    cosines = dots.join(F.broadcast(lengths_of), "template").join(norms, unit).select("path", "license", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9).alias("cosine"))
    best = cosines.where(F.col("cosine") >= min_cosine).groupBy("path").agg(F.max("cosine").alias("cosine"), F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"))
    return best.select("path", "license", "cosine")


def directory(path: Column) -> Column:
    """All before the last slash; empty for a file at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """The directory itself, those above it and the top (empty)."""
    parts = F.split(folder, "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_distinct(F.array_append(each, F.lit("")))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, min_cosine: float = 0.75) -> DataFrame:
    """path, license, cosine (null if inherited) and origin (header, or the directory that it comes from) of
    each path. files: path, text, is_license_file."""
    own = materialize(headers(files, templates, min_cosine), "license-headers")
    names = materialize(files.where("path is not null").groupBy("path").agg(F.max(F.coalesce("is_license_file", F.lit(False))).alias("gives")).withColumn("folder", directory(F.col("path"))), "license-names")
    given = names.where("gives").join(own, "path").groupBy("folder").agg(F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"))
    given = materialize(given.select(F.col("folder").alias("above"), "license"), "license-given")
    folders = names.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
    nearest = folders.join(given, "above").groupBy("folder").agg(F.max_by(F.struct("above", "license"), F.length("above")).alias("from"))
    nearest = materialize(nearest, "license-nearest")
    out = names.join(own, "path", "left").join(nearest, "folder", "left")
    return out.select("path", F.coalesce("license", "from.license").alias("license"), "cosine", F.when(F.col("license").isNotNull(), "header").otherwise(F.col("from.above")).alias("origin"))


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files source/language/block of 64 ids/id; the first id of a block is its directory's licence
    file, the first block of a language also that of the language's directory."""
    block = F.floor(F.col("doc_id") / 64)
    first = F.col("doc_id") % 64 == 0
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    path = F.when(first & (block % 16 == 0), F.concat_ws("/", folder, F.col("doc_id"))).otherwise(F.concat_ws("/", folder, block, F.col("doc_id")))
    return docs.where("doc_id is not null").select(path.alias("path"), "text", first.alias("is_license_file"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(document_files(table(spark, sf_dir, "documents")))
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "origin")
