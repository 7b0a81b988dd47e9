"""License scans: TF-IDF cosine to templates, then nearest-ancestor inheritance by path joins.

Candidates are every line of every file, every file's header (its lines up to the
first blank one, taken together if there are several), and of a licence file the whole text.
Candidates and templates are sparse TF-IDF vectors; document frequencies of all terms are
counted over all files, so a candidate's length does not depend on how large the corpus
is. A file's own licence is the template with the highest cosine, at least ``LEAST``.

Most candidates are set aside before their vectors are built, without loss: a template's
most frequent terms whose squared weights sum to less than ``LEAST`` squared can't lift a cosine
to ``LEAST`` on their own, so a candidate must hold one of the template's other terms (its
telling terms).

Files without an own licence inherit from the nearest ancestor directory
with licence files that agree; a directory whose licence files disagree passes
nothing down, and hides nothing further up.

All of it is DataFrame operations. What is broadcast by hint is bounded by the templates'
terms; other terms of candidates meet their counts in an equi-join.
A directory that holds a third of all files costs one row for each file in an equi-join
with one row for each directory, which the engine may split.

Defined results: null texts and paths are empty; an empty path has no directory but the
root; repeated paths are scanned as one file each and give one row each; ties go to
the template named first, then the header, the whole text, and the earlier line. Other columns are not read.
"""

from __future__ import annotations

import collections
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: fixed values: notices in full
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: The origin of this software must not be misrepresented; altered source versions must be plainly marked as such; this notice may not be removed
or altered from any source distribution."""

#: fixed values: license ids with the statements by which files declare them
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_AS_IS}"),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL),
    ("Zlib", _ZLIB),
)
HEADER, WHOLE = -2, -1  # the line numbers of these candidates
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"
TERM_GAP = r"[^\p{L}\p{N}]+"
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_GAP), lambda t: t != "")


def template_vectors(df: dict[str, int], total: int, least: float) -> tuple[list[tuple], list[str]]:
    """Rows (tid, license, term, v) of unit vectors times idf, and the telling terms of all templates."""
    rows, telling = [], set()
    for tid, (name, text) in enumerate(TEMPLATES):
        tf = collections.Counter(t for t in re.split("[^a-z0-9]+", text.lower()) if t)
        idf = {t: math.log((total + 1.0) / (df.get(t, 0) + 1)) + 1 for t in tf}
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        rows += [(tid, name, t, n * idf[t] / norm * idf[t]) for t, n in tf.items()]
        left = (least - 1e-5) ** 2  # similarities are rounded to six places
        for t in sorted(tf, key=lambda t: (-df.get(t, 0), t)):
            share = (tf[t] * idf[t] / norm) ** 2
            if share < left:
                left -= share
            else:
                telling.add(t)
    return rows, sorted(telling)


def own_licenses(files: DataFrame, path: Column, text: Column, is_license_file: Column, least: float = LEAST) -> DataFrame:
    """(path, tid, license, similarity, line, is_file): the best match of each path that has one."""
    spark = files.sparkSession
    rows = files.select(F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(is_license_file, F.lit(False)).alias("is_file"))
    # the empty term stands for the file itself, so one pass counts files and terms
    counts = rows.select(F.explode(F.array_union(F.array(F.lit("")), terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = materialise(counts, "term-counts")
    vocabulary = sorted({t for _, text in TEMPLATES for t in re.split("[^a-z0-9]+", text.lower()) if t})
    seen = {r.term: r.df for r in counts.where(F.col("term").isin(["", *vocabulary])).collect()}  # at most one row for each term of the templates
    total = seen.pop("", 0)
    found, telling = template_vectors(seen, total, least)
    vectors = spark.createDataFrame(found, "tid int, license string, term string, v double")
    weight = lambda df: F.log((F.lit(float(total)) + 1) / (df + 1)) + 1
    idf = spark.createDataFrame([(t, seen.get(t, 0)) for t in vocabulary], "term string, df long").select("term", weight(F.col("df")).alias("idf"))

    lines = rows.select("path", "is_file", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("int").alias("line"), terms(x).alias("ws"), (F.trim(F.translate(x, "\t\r", "  ")) == "").alias("blank"))).alias("lines"))
    blank = F.filter("lines", lambda s: s["blank"])
    upto = F.when(F.size(blank) > 0, F.get(blank, F.lit(0))["line"]).otherwise(F.size("lines"))
    joined = lambda n, part: F.struct(F.lit(n).alias("line"), F.flatten(F.transform(part, lambda s: s["ws"])).alias("ws"))
    none = F.expr("cast(array() as array<struct<line:int,ws:array<string>>>)")
    header = F.when(upto > 1, F.array(joined(HEADER, F.slice("lines", 1, F.greatest(upto, F.lit(1)))))).otherwise(none)
    whole = F.when(F.col("is_file"), F.array(joined(WHOLE, F.col("lines")))).otherwise(none)
    each_line = F.transform("lines", lambda s: F.struct(s["line"].alias("line"), s["ws"].alias("ws")))
    telling = F.array(*map(F.lit, telling)) if telling else F.expr("cast(array() as array<string>)")
    told = F.filter(F.concat(header, whole, each_line), lambda s: F.arrays_overlap(s["ws"], telling))
    parts = lines.select("path", "is_file", F.explode(told).alias("s")).select("path", "is_file", "s.line", "s.ws", F.xxhash64("s.ws").alias("h")).distinct()
    part = ["path", "is_file", "line", "h"]
    spelt = parts.select(*part, F.explode("ws").alias("term")).groupBy(*part, "term").agg(F.count("*").alias("tf"))
    named = spelt.join(F.broadcast(idf), "term")
    others = spelt.join(F.broadcast(idf), "term", "left_anti").join(counts, "term").withColumn("idf", weight(F.col("df"))).drop("df")
    # the length of a candidate rides along as its own row, so one grouping gives products and length
    length = named.unionByName(others).select(*part, F.lit(-1).alias("tid"), F.lit("").alias("license"), F.pow(F.col("tf") * F.col("idf"), 2).alias("x"))
    products = named.join(F.broadcast(vectors), "term").select(*part, "tid", "license", (F.col("tf") * F.col("v")).alias("x"))
    sums = length.unionByName(products).groupBy(*part, "tid", "license").agg(F.sum("x").alias("x"))
    each = sums.groupBy(*part).agg(
        F.sqrt(F.max(F.when(F.col("tid") == -1, F.col("x")))).alias("norm"),
        F.max(F.when(F.col("tid") >= 0, F.struct(F.round("x", 9).alias("x"), (-F.col("tid")).alias("t"), F.col("license").alias("l")))).alias("best"),
    ).where("best is not null")
    each = each.withColumn("similarity", F.round(F.col("best.x") / F.col("norm"), 6)).where(F.col("similarity") >= least)
    top = F.struct("similarity", F.col("best.t").alias("t"), (-F.col("line")).alias("nl"), F.col("best.l").alias("l"))
    return each.groupBy("path", "is_file").agg(F.max(top).alias("m")).select(
        "path", "is_file", (-F.col("m.t")).alias("tid"), F.col("m.l").alias("license"), F.col("m.similarity").alias("similarity"), (-F.col("m.nl")).alias("line")
    )


def directory(path: Column) -> Column:
    """The path without its last part; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Array of (depth, dir): the file's directory and all above it, the root at depth 0."""
    parts = F.filter(F.split(directory(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, path: Column, text: Column, is_license_file: Column | None = None, least: float = LEAST) -> DataFrame:
    """One row for each file: path, license, similarity, origin ('own', 'inherited' or 'none'), from_dir."""
    marked = is_license_file if is_license_file is not None else path.rlike(FILE_NAME)
    own = materialise(own_licenses(files, path, text, marked, least), "licenses")
    dirs = own.where("is_file").groupBy(F.array_join(F.filter(F.split(directory(F.col("path")), "/"), lambda p: p != ""), "/").alias("dir")).agg(
        F.max("license").alias("dir_license"), F.min("license").alias("least"), F.max("similarity").alias("dir_similarity")
    ).where("dir_license = least").drop("least")
    names = files.select(F.coalesce(path, F.lit("")).alias("path"))
    best = own.groupBy("path").agg(F.max(F.struct("similarity", (-F.col("tid")).alias("t"), "license")).alias("o"))
    rows = names.join(best, "path", "left")
    lone = names.distinct().join(best, "path", "left_anti")
    met = lone.select("path", F.explode(ancestors(F.col("path"))).alias("a")).join(dirs, F.col("a.dir") == F.col("dir"))
    nearest = met.groupBy("path").agg(F.max(F.struct(F.col("a.depth").alias("depth"), "dir", "dir_license", "dir_similarity")).alias("i"))
    out = rows.join(nearest, "path", "left")
    return out.select(
        "path", F.coalesce("o.license", "i.dir_license").alias("license"), F.coalesce("o.similarity", "i.dir_similarity").alias("similarity"),
        F.when(F.col("o").isNotNull(), "own").when(F.col("i").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("i.dir").alias("from_dir"),
    )
