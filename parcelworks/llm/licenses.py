"""Licence scan: sparse TF-IDF cosine to templates, then nearest-ancestor
directory inheritance (native).

Every line of a text that holds a licence anchor word, blocks of adjacent lines
about it, and the whole text are compared with notices, headers and texts of known
licences by TF-IDF cosine. Inverse document frequencies of these templates' words
count all documents; other words weigh as if they were in one document each. The
best line or block is a document's header; a document whose whole text is close to
a template is a licence file and rules its directory.
Documents without a licence of their own inherit that of the nearest ancestor
directory with one, by a join over the ancestors of their paths.

Defined results: null or empty text has no licence of its own; a null path has
no directory; ties go to the first licence name in order; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

# Licence names and short notices as licensors publish them.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."],
    "BSD-2-Clause": [],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain under the Unlicense."],
}
#: The line by which a file names its licence.
SPDX = "SPDX-License-Identifier: "


def _gnu(name: str, version: str) -> list[str]:
    """The header of the GNU licences: its first paragraph, and all of it."""
    first = (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    rest = (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the "
        f"{name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )
    return [first, f"{first} {rest}"]


HEADERS = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/"
    ],
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
}
#: Licences whose whole text is in ``licence_texts``.
TEXTS = ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
# The AGPL is the GPL 3 with another name and section 13.
_REMOTE = (
    "Remote Network Interaction. Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
    "prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source."
)


def _templates() -> dict[str, list[str]]:
    """The notices, headers, identifier line and texts of each licence. The BSD licences
    are also held with their holder unnamed, the one of two clauses without the third."""
    texts = {n: (files(__package__) / "licence_texts" / f"{n}.txt").read_text(encoding="utf-8") for n in TEXTS}
    texts["AGPL-3.0"] = re.sub(r"(?i)GNU\s+General\s+Public", "GNU Affero General Public", texts["GPL-3.0"]) + _REMOTE
    three = texts["BSD-3-Clause"].replace("REGENTS", "COPYRIGHT HOLDERS").replace("the University", "the copyright holder").split("\n\n", 1)[1]
    texts["BSD-2-Clause"] = re.sub(r"(?s)3\. Neither.*?permission\.\n", "", three)
    more = {"BSD-3-Clause": [three]}
    return {n: [*notices, SPDX + n, *HEADERS.get(n, []), *([texts[n]] if n in texts else []), *more.get(n, [])] for n, notices in TEMPLATES.items()}


#: Lines of the blocks that begin at a line with an anchor or at the one before.
BLOCKS = (2, 3, 4, 6, 8, 12, 16, 24, 32)
ANCHOR = r"(?i)licen[cs]e|copyright|redistribution|permission is hereby"
SPLIT = r"[^a-z0-9+-]+"
#: Least cosine of a header line, and of a whole text to be a licence file.
HEADER, FILE = 0.75, 0.6


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def _template_rows() -> list[tuple[str, int, str, int]]:
    rows = []
    for name, notices in _templates().items():
        for i, notice in enumerate(notices):
            words = terms(notice)
            rows += [(name, i, t, words.count(t)) for t in sorted(set(words))]
    return rows


def vocabulary() -> list[str]:
    return sorted({r[2] for r in _template_rows()})


def _tokens(text) -> F.Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) for the notices' words over every document, and n under ''."""
    vocab = F.array(*map(F.lit, vocabulary()))
    held = F.array_intersect(_tokens("text"), vocab)
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("term"))
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def scan(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, path, license, score, how (header, file, inherited or none),
    from_dir, for every row. ``docs``: doc_id, path, text."""
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "path",
        F.when(F.col("text").rlike(ANCHOR), F.col("text")).alias("_text"),
    )
    base = materialise(base, "licence-candidates")
    # At most as many rows as the notices have words, and one.
    df = {r["term"]: r["df"] for r in document_frequencies(docs).collect()}
    n = max(1, df.get("", 1))
    idf = {t: _idf(n, df.get(t, 0)) for t in vocabulary()}
    top = _idf(n, 1)
    rows = [(name, i, t, tf * idf[t]) for name, i, t, tf in _template_rows()]
    norm: dict[tuple[str, int], float] = {}
    for name, i, _, w in rows:
        norm[name, i] = norm.get((name, i), 0.0) + w * w
    weights = spark.createDataFrame(
        [(name, i, t, w / norm[name, i] ** 0.5, idf[t]) for name, i, t, w in rows],
        "license string, notice int, term string, w double, idf double",
    )
    known = spark.createDataFrame([(t, idf[t]) for t in vocabulary()], "term string, idf double")
    n_lines = F.size("_lines")
    anchored = F.filter(F.sequence(F.lit(1), n_lines), lambda i: F.element_at("_lines", i).rlike(ANCHOR))

    def about(i):
        at = lambda j, k: F.struct(j.alias("at"), F.least(F.lit(k), n_lines - j + 1).alias("n"))
        return F.array(at(i, 1), *(at(F.greatest(F.lit(1), i - back), k) for back in (0, 1) for k in BLOCKS))

    blocks = F.array_distinct(F.flatten(F.transform(anchored, about)))
    units = base.where("_text IS NOT NULL").withColumn("_lines", F.split("_text", "\n")).select("_row", "_text", "_lines", F.posexplode(
        F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))), blocks)
    ).alias("unit", "_b")).select(
        "_row", "unit", F.when(F.col("unit") == 0, F.col("_text")).otherwise(F.array_join(F.slice("_lines", F.greatest(F.lit(1), F.col("_b.at")), F.col("_b.n")), "\n")).alias("_unit")
    )
    words = units.select("_row", "unit", F.explode(_tokens("_unit")).alias("term")).groupBy("_row", "unit", "term").count()
    valued = words.join(F.broadcast(known), "term", "left")
    norms = valued.groupBy("_row", "unit").agg(
        F.sum(F.when(F.col("idf").isNotNull(), F.pow(F.col("count") * F.col("idf"), 2)).otherwise(F.col("count") * F.lit(top * top))).alias("_sq")
    )
    dots = words.join(F.broadcast(weights), "term").groupBy("_row", "unit", "license", "notice").agg(
        F.sum(F.col("count") * F.col("idf") * F.col("w")).alias("_dot")
    )
    cosine = dots.join(norms, ["_row", "unit"]).select(
        "_row", "unit", "license", F.round(F.least(F.lit(1.0), F.col("_dot") / F.sqrt("_sq")), 9).alias("cos")
    )
    whole = (F.col("unit") == 0) & (F.col("cos") >= FILE)
    head = (F.col("unit") > 0) & (F.col("cos") >= HEADER)
    # The best score; of equal ones the first name: names are compared inverted
    # by taking the smallest of those at the best score.
    good = cosine.where(whole | head).withColumn("file", whole)
    best = good.groupBy("_row").agg(
        F.min(F.struct((-F.col("cos")).alias("neg"), "license")).alias("b"), F.max("file").alias("file")
    )
    own = base.drop("_text").join(best.select("_row", F.col("b.license").alias("_own"), (-F.col("b.neg")).alias("_score"), "file"), "_row", "left")
    own = materialise(own, "licence-own")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rules = own.where("file AND path IS NOT NULL").groupBy(folder.alias("dir")).agg(
        F.min(F.struct((-F.col("_score")).alias("neg"), F.col("_own").alias("license"))).alias("r")
    ).select("dir", F.col("r.license").alias("_ruled"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asking = own.where("_own IS NULL AND path LIKE '%/%'").select("_row", F.posexplode(ancestors).alias("depth", "dir"))
    near = asking.join(rules, "dir").groupBy("_row").agg(F.max(F.struct("depth", "_ruled", "dir")).alias("m"))
    out = own.join(near, "_row", "left")
    how = F.when(F.col("file"), "file").when(F.col("_own").isNotNull(), "header").when(F.col("m").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id", "path", F.coalesce("_own", F.col("m._ruled")).alias("license"), F.col("_score").alias("score"),
        how.alias("how"), F.col("m.dir").alias("from_dir"),
    )


def _idf(n: int, df: int) -> float:
    import math

    return math.log((1 + n) / (1 + df)) + 1


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a folder per source, one per language below it."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), spark)
