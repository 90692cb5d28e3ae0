"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A header is a line or a paragraph (wrapped notices are several lines); a licence file is compared by its whole text and by
its opening, for licences that are too long to quote. A term weighs (1 + ln tf) (1 + ln((1 + n) / (1 + df))); the
document frequencies df are those of all words over all n texts. A header
can only reach the threshold with one of its template's anchor terms: without them the rest of the template's weight is too
small (Cauchy-Schwarz), whatever else it holds, so lines and paragraphs without an anchor are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: Fixed wording of public licences, as (licence, kind, text). A header is compared with lines and paragraphs, a file with the
#: whole text of a licence file, an opening with such a file's first words.
TEMPLATES = (
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "header", "Released under the MIT License."),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "header", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "header", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "header", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "header", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "header", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "header", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "header", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "header", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "header", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "header", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "header", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "header", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "header", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "file", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "file", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "file", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "opening", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "opening", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "opening", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "opening", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("AGPL-3.0", "opening", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "opening", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
)
#: First words of a licence file that an opening is compared with.
OPENING = 60
THRESHOLD = 0.6
TERM = "[a-z0-9]+"
LICENCE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING)[^/]*$"


def _terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def anchors(weights: dict[str, float], threshold: float) -> set[str]:
    """Fewest terms, heaviest first, without which the others' weight is under the threshold's part of the whole."""
    left = sum(w * w for w in weights.values())
    limit = (threshold - 1e-9) ** 2 * left
    out = set()
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if left < limit:
            break
        out.add(t)
        left -= w * w
    return out


def _lower_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as literals of the plan."""
    cells = lambda r: ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST('{x!r}' AS DOUBLE)" if isinstance(x, float) else str(x) for x in r)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({cells(r)})' for r in rows)} AS t({schema})")


#: Between paragraphs: a line without letters and digits.
BLANK = "\n[^a-zA-Z0-9\n]*\n"


def statements(files: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(path, licence, score) of the files that carry a statement: the best of their headers and, for licence files, the whole."""
    spark = files.sparkSession
    counted = [(name, kind, _terms(text)) for name, kind, text in templates]
    n = files.count()
    # how many texts hold each word; the table has the corpus's vocabulary
    often = scratch.keep(files.where("text IS NOT NULL").select(F.explode(F.array_distinct(_lower_terms(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df")), "frequencies")
    words = sorted({t for _, _, c in counted for t in c})
    found = {r["t"]: r["df"] for r in often.where(F.col("t").isin(words)).collect()}  # a row for each term of the templates
    idf = {w: math.log((1 + n) / (1 + found.get(w, 0))) + 1 for w in words}
    weights = [{t: (1 + math.log(c)) * idf[t] for t, c in terms.items()} for _, _, terms in counted]
    norms = [math.sqrt(sum(w * w for w in x.values())) for x in weights]
    need = sorted(set().union(*[anchors(x, threshold) for x, (_, kind, _) in zip(weights, counted, strict=True) if kind == "header"]))
    pattern = rf"(?<![a-z0-9])({'|'.join(map(re.escape, need))})(?![a-z0-9])" if need else "a^"
    likely = files.where(F.lower("text").rlike(pattern))
    cut = lambda sep, part: F.transform(F.split("text", sep), lambda x, i: F.struct((2 * i + part).alias("line"), x.alias("x")))
    headers = likely.select("path", F.explode(F.concat(cut("\n", 0), F.filter(cut(BLANK, 1), lambda u: F.contains(u["x"], F.lit("\n"))))).alias("u"))
    headers = headers.select("path", F.lit("header").alias("kind"), "u.line", "u.x").where(F.lower("x").rlike(pattern)).select("path", "kind", "line", _lower_terms(F.col("x")).alias("ts"))
    own = files.where(F.col("path").rlike(LICENCE_FILE) & F.col("text").isNotNull()).select("path", _lower_terms(F.col("text")).alias("ts"))
    whole = own.select("path", F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.lit(-1).alias("line"), F.col("ts")), F.struct(F.lit("opening").alias("kind"), F.lit(-2).alias("line"), F.slice("ts", 1, OPENING).alias("ts")))).alias("u")).select("path", "u.kind", "u.line", "u.ts")
    terms = scratch.keep(headers.union(whole).select("path", "kind", "line", F.explode("ts").alias("t")).groupBy("path", "kind", "line", "t").agg(F.count("*").alias("tf")), "terms")
    # both sides are written, so a frequent word's rows can be split
    weighed = terms.join(often, "t").withColumn("w", (1 + F.ln("tf")) * (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    unit = ["path", "kind", "line"]
    against = _values(spark, [(kind, name, i, t, w / norms[i]) for i, (name, kind, _) in enumerate(counted) for t, w in weights[i].items()], "kind, licence, template, t, tw")
    # a unit's own length is carried by its rows: the templates' terms are a map of each word, so no row is made twice
    held = against.groupBy("t").agg(F.collect_list(F.struct("kind", "licence", "template", "tw")).alias("m"))
    matched = weighed.join(F.broadcast(held), "t", "left")
    length = matched.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.flatten(F.collect_list(F.transform(F.filter("m", lambda x: x["kind"] == F.col("kind")), lambda x: F.struct(x["licence"].alias("licence"), x["template"].alias("template"), (x["tw"] * F.col("w")).alias("dot"))))).alias("dots"))
    dots = length.select(*unit, "norm", F.explode("dots").alias("d")).groupBy(*unit, "norm", "d.licence", "d.template").agg(F.sum("d.dot").alias("dot"))
    scored = dots.withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= threshold)
    best = scored.groupBy("path", "licence").agg(F.max("score").alias("score"))
    first = Window.partitionBy("path").orderBy(F.desc(F.floor(F.col("score") * 1e6 + 0.5)), "licence")
    return scratch.keep(best.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("path", "licence", "score"), "statements")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(dirs: DataFrame, declared: DataFrame) -> DataFrame:
    """(dir, origin, licence) of the nearest directory at or above each of ``dirs`` in ``declared`` (dir, licence)."""
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    above = dirs.select("dir", F.explode(F.array_distinct(up)).alias("origin"))
    held = above.join(declared.select(F.col("dir").alias("origin"), "licence"), "origin")
    return held.groupBy("dir").agg(F.max(F.struct(F.length("origin").alias("depth"), "origin", "licence")).alias("best")).select("dir", "best.origin", "best.licence")


def license_scan(files: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``files`` (with path and text) plus licence, licence_from (own, inherited or none), licence_dir and licence_score.

    A file's own statement comes first. Otherwise it takes the licence that licence files declare for the nearest directory
    at or above its own; of several there, the highest score, then the smallest name. Null and empty texts state nothing;
    a null path is one in the root. Rows of one path are one file. Scores are in millionths. An empty table gives no rows.
    """
    new = ["licence", "licence_from", "licence_dir", "licence_score"]
    kept = [c for c in files.columns if c not in new]
    named = files.select(F.coalesce("path", F.lit("")).alias("path"), "text")
    found = statements(named, scratch, threshold, templates)
    of_files = found.where(F.col("path").rlike(LICENCE_FILE)).withColumn("dir", directory(F.col("path")))
    first = Window.partitionBy("dir").orderBy(F.desc(F.floor(F.col("score") * 1e6 + 0.5)), "licence", "path")
    declared = of_files.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("dir", "licence")
    dirs = named.select(directory(F.col("path")).alias("dir")).distinct()
    near = scratch.keep(inherited(dirs, declared), "inherited")
    rows = files.select(F.struct(*kept).alias("row_"), F.coalesce("path", F.lit("")).alias("path_")).withColumn("dir_", directory(F.col("path_")))
    joined = rows.join(found.select(F.col("path").alias("path_"), F.col("licence").alias("own_"), "score"), "path_", "left").join(near.select(F.col("dir").alias("dir_"), "origin", F.col("licence").alias("above_")), "dir_", "left")
    return joined.select(
        *[F.col(f"row_.{c}").alias(c) for c in kept],
        F.coalesce("own_", "above_").alias("licence"),
        F.when(F.col("own_").isNotNull(), "own").when(F.col("above_").isNotNull(), "inherited").otherwise("none").alias("licence_from"),
        F.when(F.col("own_").isNull(), F.col("origin")).alias("licence_dir"),
        F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("licence_score"),
    )


#: The documents have no paths, so the query lays them out: source, language, thousands, hundreds; short texts are licence files, the shorter the higher.
_PATH = """concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/',
  CASE WHEN n_chars < 200 THEN 'LICENSE-' WHEN n_chars < 400 THEN concat(CAST(doc_id {div} 1000 AS {text}), '/LICENSE-')
  WHEN n_chars < 600 THEN concat(CAST(doc_id {div} 1000 AS {text}), '/', CAST(doc_id {div} 100 AS {text}), '/LICENSE-')
  ELSE concat(CAST(doc_id {div} 1000 AS {text}), '/', CAST(doc_id {div} 100 AS {text}), '/doc-') END, CAST(doc_id AS {text}), '.txt')"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_PATH.format(div="div", text="STRING")).alias("path"))
    return license_scan(docs, Scratch(spark, "licences")).select("doc_id", "path", "licence", "licence_from", "licence_dir", "licence_score")


def _oracle() -> str:
    quoted = ", ".join(f"({i}, '{name}', '{kind}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, kind, text) in enumerate(TEMPLATES))
    licence = LICENCE_FILE
    return rf"""WITH tpl(i, licence, kind, text) AS (VALUES {quoted}),
tt AS (SELECT i, licence, kind, t, count(*) AS tf FROM (SELECT i, licence, kind, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM tpl) GROUP BY ALL),
f AS (SELECT doc_id, text, {_PATH.format(div="//", text="VARCHAR")} AS path FROM documents),
dt AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM documents) GROUP BY t),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT i, licence, kind, t, (1 + ln(tf)) * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tt CROSS JOIN n LEFT JOIN dt USING (t)),
tw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS tw FROM w),
u AS (SELECT path, 'header' AS kind, regexp_extract_all(lower(x), '{TERM}') AS ts, 2 * line AS line FROM (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f)
  UNION ALL SELECT path, 'header', regexp_extract_all(lower(x), '{TERM}'), 2 * line + 1 FROM (SELECT path, unnest(regexp_split_to_array(text, '{BLANK.replace(chr(10), chr(92) + "n")}')) AS x, generate_subscripts(regexp_split_to_array(text, '{BLANK.replace(chr(10), chr(92) + "n")}'), 1) AS line FROM f) WHERE contains(x, chr(10))
  UNION ALL SELECT path, 'file', regexp_extract_all(lower(text), '{TERM}'), -1 FROM f WHERE regexp_matches(path, '{licence}')
  UNION ALL SELECT path, 'opening', regexp_extract_all(lower(text), '{TERM}')[1:{OPENING}], -2 FROM f WHERE regexp_matches(path, '{licence}')),
ut AS (SELECT path, kind, line, t, count(*) AS tf FROM (SELECT path, kind, line, unnest(ts) AS t FROM u) GROUP BY ALL),
uw AS (SELECT path, kind, line, t, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM ut CROSS JOIN n JOIN dt USING (t)),
un AS (SELECT path, kind, line, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
s AS (SELECT uw.path, tw.licence, sum(uw.w * tw.tw) / any_value(un.norm) AS score FROM uw JOIN tw ON tw.kind = uw.kind AND tw.t = uw.t JOIN un ON un.path = uw.path AND un.kind = uw.kind AND un.line = uw.line GROUP BY uw.path, uw.kind, uw.line, tw.licence, tw.i HAVING sum(uw.w * tw.tw) / any_value(un.norm) >= {THRESHOLD}),
own AS (SELECT path, licence, floor(max(score) * 1e6 + 0.5) AS score FROM s GROUP BY path, licence QUALIFY row_number() OVER (PARTITION BY path ORDER BY floor(max(score) * 1e6 + 0.5) DESC, licence) = 1),
decl AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, licence FROM own WHERE regexp_matches(path, '{licence}') QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, licence, path) = 1),
near AS (SELECT f.path, decl.dir, decl.licence FROM f JOIN decl ON decl.dir = '' OR starts_with(regexp_replace(f.path, '/?[^/]*$', '') || '/', decl.dir || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(decl.dir) DESC) = 1)
SELECT doc_id, f.path, coalesce(own.licence, near.licence) AS licence, CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS licence_from,
  CASE WHEN own.licence IS NULL THEN near.dir END AS licence_dir, CAST(own.score AS BIGINT) AS licence_score
FROM f LEFT JOIN own ON own.path = f.path LEFT JOIN near ON near.path = f.path"""


OP2_SQL = _oracle()
