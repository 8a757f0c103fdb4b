"""License scans: sparse TF-IDF cosine of headers and licence files to
templates, then inheritance from the nearest ancestor directory by path joins.

 1. the units of a file's text (markup stripped) are its lines, its paragraphs
    (lines up to the next empty one: a header of several lines) and, for a
    licence file (``LICENSE``, ``COPYING``, ..., or the index page of a
    directory), the whole text.  A unit without one of the ``telling_terms``
    cannot be close to any template and is left out;
 2. the distinct units are saved once; a unit that a third of all files share
    is one row from then on;
 3. terms are weighted by (1 + ln tf) * (ln((1 + templates) / (1 + df)) + 1),
    where df counts the templates with the term: what a notice scores does not depend on
    how often it, or anything else, stands in the files.  The dot products are
    a join of unit terms with template terms (a fixed table); the best template
    with a cosine of at least ``MIN_COSINE`` is the unit's licence, the best
    unit of a file the file's own;
 4. a file without one takes the licence of the nearest directory above it
    that has one: distinct directories are expanded to their ancestors and
    joined with the directories that state a licence.

Telling terms (prefix filtering): of each template the terms of largest weight,
common words last, so many that the others together have less than
``MIN_COSINE`` of its length.  A unit with none of them has a cosine below
that, whatever else it says.

DataFrame and SQL functions only.

Defined results: a null text has no units; a null or empty path is the empty
directory; repeated rows are one file (same id and path) and get the same
result each; equal cosines go to the first licence by name; extra columns are
ignored, also those with names used here; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import saved

MIN_COSINE = 0.6

#: fixed values: public licence notices, as (licence, text)
TEMPLATES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    # whole notices
    ("Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain "
     "the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided "
     "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
     "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
     "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
     "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
     "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
     "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
     "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
     "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain "
     "the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided "
     "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
     "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN "
     "NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
     "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
     "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
     "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
     "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
     "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-3.0",
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of "
     "the License, or (at your option) any later version. This program is distributed in the hope "
     "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details. You should have received a copy of the GNU General Public License along with this "
     "program. If not, see https://www.gnu.org/licenses/."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
     "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
     "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
     "SOFTWARE."),
)

#: fixed values: words that any text has; they tell little, and templates alone cannot show it
COMMON = frozenset("a all an and any are as at be but by can do each either even for from has have however if in into is it its later "
                   "list may more must name neither no nor not of on or other out see shall should so such than that the there these "
                   "this to under unless upon use used was way what whether will with without work you your 0 1 2 3 4".split())
COMMON_WEIGHT = 0.25

MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
LICENCE_FILE = r"^(licen[sc]e|unlicense|copying|copyright|notice)([.-].*)?$|^index[.].*$|^$"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _counts(templates) -> list[Counter]:
    return [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]


def inverse_frequency(templates=TEMPLATES) -> dict[str, float]:
    """Weight of each term of the templates."""
    df = Counter(t for c in _counts(templates) for t in c)
    return {t: (math.log((1 + len(templates)) / (1 + n)) + 1) * (COMMON_WEIGHT if t in COMMON else 1) for t, n in df.items()}


def template_terms(templates=TEMPLATES) -> list[dict[str, float]]:
    """Weights of the terms of each template, of length 1."""
    idf, out = inverse_frequency(templates), []
    for c in _counts(templates):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def telling_terms(min_cosine: float, templates=TEMPLATES) -> list[str]:
    """Of each template the terms of largest weight, common words last, until
    the rest is shorter than ``min_cosine`` (with room for rounding)."""
    out = set()
    for weights in template_terms(templates):
        rest = 1.0
        for t, w in sorted(weights.items(), key=lambda x: (x[0] in COMMON, -x[1], x[0])):
            if rest < (min_cosine - 1e-5) ** 2:
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def gate(min_cosine: float) -> str:
    """Pattern of a (lower-case) text with a telling term; terms are grouped by
    their first letter, so that most words are passed over at once."""
    by: dict[str, list[str]] = {}
    for t in telling_terms(min_cosine):
        by.setdefault(t[0], []).append(t[1:])
    return f"(?<![a-z0-9])({'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in by.items())})(?![a-z0-9])"


def _fixed(spark, rows: list, schema: str) -> DataFrame:
    """A small fixed table, without a Python worker."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def file_table(files: DataFrame, file_id: str, path: str, text: str) -> DataFrame:
    """(id, file, dir, name, text); ``file`` is a hash of id and path."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{path}`"), F.lit("")), "^[A-Za-z]+://", ""), "[?#].*$", "")
    return files.select(F.col(f"`{file_id}`").alias("id"), p.alias("p"), F.col(f"`{text}`").alias("text"),
                        F.xxhash64(F.col(f"`{file_id}`"), F.col(f"`{path}`")).alias("file")).select(
        "id", "file", F.regexp_extract("p", "^(.*/)?[^/]*$", 1).alias("dir"),
        F.translate(F.regexp_extract("p", "([^/]*)$", 1), _UP, _LOW).alias("name"), "text")


def licence_units(files: DataFrame, min_cosine: float) -> DataFrame:
    """(file, u, unit): lines, paragraphs and whole licence files, in lower
    case, with a telling term; ``u`` is the hash they are known by from here."""
    pattern = "(?i)" + gate(min_cosine)         # A-Z as a-z; only what is found is lower-cased
    x = files.filter(F.col("text").rlike(pattern)).select("file", "name", F.transform(
        F.split(F.regexp_replace("text", MARKUP, "\n"), "\n"), lambda x: F.trim(x)).alias("lines"))
    joined = lambda t: F.trim(F.replace(t, F.lit("\n"), F.lit(" ")))
    # a line with a telling term stands in a paragraph with one
    x = x.withColumn("blocks", F.filter(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda b: b.rlike(pattern)))
    paragraphs = F.transform("blocks", joined)
    lines = F.filter(F.flatten(F.transform("blocks", lambda b: F.split(b, "\n"))), lambda u: u.rlike(pattern))
    whole = F.when(F.col("name").rlike(LICENCE_FILE), F.array(joined(F.array_join("lines", "\n")))).otherwise(F.array().cast("array<string>"))
    found = F.concat(lines, paragraphs, F.filter(whole, lambda u: u.rlike(pattern)))
    units = F.array_distinct(F.transform(found, lambda u: F.translate(u, _UP, _LOW)))
    return x.select("file", F.explode(units).alias("unit")).select("file", F.xxhash64("unit").alias("u"), "unit")


def match_units(units: DataFrame, min_cosine: float) -> DataFrame:
    """(u, licence, score) of the distinct units close to a template."""
    spark = units.sparkSession
    idf = inverse_frequency()
    known = _fixed(spark, [{"k": k, "licence": TEMPLATES[k][0], "term": t, "v": v} for k, w in enumerate(template_terms()) for t, v in w.items()],
                   "k int, licence string, term string, v double")
    weights = _fixed(spark, [{"term": t, "idf": x} for t, x in idf.items()], "term string, idf double")
    once = units.groupBy("u").agg(F.any_value("unit").alias("unit"))
    terms = (once.select("u", F.explode(F.regexp_extract_all("unit", F.lit("[a-z0-9]+"), 0)).alias("term"))
             .groupBy("u", "term").agg(F.count(F.lit(1)).alias("tf")))
    # both tables are fixed and small
    a = terms.join(F.broadcast(weights), "term", "left").select(
        "u", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(1 + len(TEMPLATES)) + 1)
                                                           * F.when(F.col("term").isin(*sorted(COMMON)), COMMON_WEIGHT).otherwise(1.0))).alias("w"))
    norm = a.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dots = a.join(F.broadcast(known), "term").groupBy("u", "k", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm, "u").select("u", "licence", F.round(F.col("dot") / F.col("n"), 6).alias("score"))
    best = scored.filter(F.col("score") >= min_cosine).groupBy("u").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("u", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan_licences(files: DataFrame, file_id: str = "page_id", path: str = "url", text: str = "html",
                  min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, dir, own_license, own_score, license, from_dir) per row of
    ``files``; from_dir is the directory an inherited licence comes from."""
    table = file_table(files, file_id, path, text)
    units = saved(licence_units(table, min_cosine), "licence-units")
    own = saved(units.select("file", "u").distinct().join(match_units(units, min_cosine), "u").groupBy("file")
                .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
                .select("file", F.col("b.licence").alias("own_license"), (-F.col("b.s")).alias("own_score")), "licences")
    known = table.drop("text").join(own, "file", "left")
    stated = (known.filter(F.col("own_license").isNotNull() & F.col("name").rlike(LICENCE_FILE))
              .groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("b"))
              .select(F.col("dir").alias("from_dir"), F.col("b.own_license").alias("dir_license")))
    parts = F.split("dir", "/")
    above = known.select("dir").distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"),
                           F.when(F.col("dir") == "", "").otherwise("/")))).alias("from_dir"))
    near = (above.join(stated, "from_dir").groupBy("dir")
            .agg(F.max(F.struct(F.length("from_dir").alias("d"), "from_dir", "dir_license")).alias("b"))
            .select("dir", "b.from_dir", "b.dir_license"))
    return known.join(near, "dir", "left").select(
        "id", "dir", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    low = lambda x: f"translate({x}, '{_UP}', '{_LOW}')"
    common = f"CASE WHEN term IN ({', '.join(repr(w) for w in sorted(COMMON))}) THEN {COMMON_WEIGHT} ELSE 1.0 END"
    rows = ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(TEMPLATES))
    return rf"""WITH f AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z]+://', ''), '[?#].*$', '') AS p
  FROM pages),
g AS (SELECT page_id, url, {low('html')} AS html, regexp_extract(p, '^(.*/)?[^/]*$', 1) AS dir,
             {low("regexp_extract(p, '([^/]*)$', 1)")} AS name FROM f),
ls AS (SELECT page_id, url, name, list_transform(string_split(regexp_replace(html, '{MARKUP}', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')) AS lines
       FROM g),
l AS (
  SELECT DISTINCT page_id, url, unit FROM (
    SELECT page_id, url, unnest(list_concat(lines,
      list_transform(string_split_regex(array_to_string(lines, chr(10)), '\n\n+'), lambda x: trim(replace(x, chr(10), ' '), ' ')),
      CASE WHEN regexp_matches(name, '{LICENCE_FILE}') THEN [trim(array_to_string(lines, ' '), ' ')] ELSE [] END)) AS unit FROM ls)
  WHERE unit <> ''),
tpl(k, licence, line) AS (VALUES {rows}),
once AS (SELECT DISTINCT unit FROM l),
lt AS (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS term FROM once) GROUP BY ALL),
kt AS (SELECT k, licence, term, count(*) AS tf FROM (
  SELECT k, licence, unnest(regexp_extract_all({low('line')}, '[a-z0-9]+')) AS term FROM tpl) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM kt GROUP BY term),
a AS (SELECT unit, term, (1 + ln(tf)) * (ln({1 + len(TEMPLATES)} / (1 + coalesce(n, 0))) + 1) * {common} AS w FROM lt LEFT JOIN df USING (term)),
b AS (SELECT k, licence, term, (1 + ln(tf)) * (ln({1 + len(TEMPLATES)} / (1 + n)) + 1) * {common} AS w FROM kt JOIN df USING (term)),
sc AS (
  SELECT unit, licence, round(dot / (na * nb), 6) AS score
  FROM (SELECT a.unit, b.k, b.licence, sum(a.w * b.w) AS dot FROM a JOIN b USING (term) GROUP BY ALL)
  JOIN (SELECT unit, sqrt(sum(w * w)) AS na FROM a GROUP BY unit) USING (unit)
  JOIN (SELECT k, sqrt(sum(w * w)) AS nb FROM b GROUP BY k) USING (k)),
best AS (SELECT unit, licence, score FROM sc WHERE score >= {MIN_COSINE}
         QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) = 1),
own AS (SELECT page_id, url, licence AS own_license, score AS own_score FROM l JOIN best USING (unit)
        QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY score DESC, licence) = 1),
kn AS (SELECT g.page_id, g.dir, g.name, own_license, own_score FROM g LEFT JOIN own
       ON own.page_id IS NOT DISTINCT FROM g.page_id AND own.url IS NOT DISTINCT FROM g.url),
st AS (SELECT dir AS from_dir, own_license AS dir_license FROM kn
       WHERE own_license IS NOT NULL AND regexp_matches(name, '{LICENCE_FILE}')
       QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
near AS (SELECT d.dir, from_dir, dir_license FROM (SELECT DISTINCT dir FROM kn) d
         JOIN st ON starts_with(d.dir, st.from_dir) AND (st.from_dir <> '' OR d.dir = '')
         QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(from_dir) DESC) = 1)
SELECT page_id, kn.dir, own_license, own_score, coalesce(own_license, dir_license) AS license,
       CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM kn LEFT JOIN near ON near.dir = kn.dir"""


SQL = _sql()
