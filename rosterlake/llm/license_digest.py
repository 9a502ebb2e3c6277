"""Canonical digest lookup of licence texts, in DataFrame functions only.

Texts are made canonical: lower case, copyright lines dropped, equivalent
spellings made one, punctuation and spacing reduced to single spaces. The
SHA-256 of the whole canonical text is hash-joined to the digests of known
licences; lines that speak of a licence are looked up the same way, as notices.
The known table is any DataFrame of (license_id, text); Spark broadcasts it
only if its size allows. By default it is KNOWN and licenses.jsonl beside this
file: full texts of the licences listed in README with the usual titles, and
notices ("Licensed under the ...", SPDX lines). Of a line that speaks of a
licence, its sentences, and what stands before "see ...", are looked up too, so
a notice behind a copyright or before a reference is found. Not found: other
licences, texts with changed words, notices that run over several lines.
ORACLE is the SQL of KNOWN and whole lines only.

Edge cases: null and empty texts, and texts that are copyright lines only, have
an empty canonical form, digest null and no licence; if two known texts share a
digest the first id counts; repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import row_key

# Wordings of published licences and of the usual notices.
KNOWN = [
    ("MIT", 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
# Spellings that count as the same.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"),
    ("authorised", "authorized"), ("unauthorised", "unauthorized"), ("modernise", "modernize"), ("fulfilment", "fulfillment"), ("copyright owner", "copyright holder"), ("http://", "https://"),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright(?: \(c\)| ©)? (?:\d|©|\(c\)|by |the )|\(c\) |© |all rights reserved)[^\n]*$"
SPEAKS_OF = r"(?i)licen[cs]e|released under|public domain|creative commons|copyright"


# What a text must hold, in lower case, for a line of it to match; found by plain search, without a regular expression.
COPYRIGHT_MARKS = ["copyright", "(c) ", "© ", "all rights reserved"]
SPEAKING = ["license", "licence", "released under", "public domain", "creative commons", "copyright"]


def holds(text: Column, marks: list[str]) -> Column:
    return reduce(Column.__or__, [F.lower(text).contains(m) for m in marks])


def canonical(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(holds(text, COPYRIGHT_MARKS), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    with open(Path(__file__).with_name("licenses.jsonl"), encoding="utf-8") as f:
        more = [(r["license_id"], r["text"]) for r in map(json.loads, f)]
    return spark.createDataFrame(KNOWN + more, "license_id string, text string")


def pieces(line: Column) -> Column:
    """The line, its sentences, and each without what it refers to."""
    parts = F.concat(F.array(line), F.split(line, r"(?<=[.;!?])\s+"))
    return F.array_distinct(F.concat(parts, F.transform(parts, lambda x: F.regexp_replace(x, r"(?i)[\s,;(.-]+see\b.*$", ""))))


def digests_of(known: DataFrame) -> DataFrame:
    return known.select(digest(F.col("text")).alias("known_digest"), "license_id").where("known_digest is not null").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest, license_id (null if none), notices (ids, comma-joined), n_notices."""
    spark = docs.sparkSession
    table = digests_of(known if known is not None else known_licenses(spark))
    rows = docs.select("doc_id", row_key().alias("__key"), digest(F.coalesce("text", F.lit(""))).alias("digest"))
    whole = rows.join(table.select(F.col("known_digest").alias("digest"), "license_id"), "digest", "left")
    lines = docs.where(holds(F.col("text"), SPEAKING)).select(row_key().alias("__key"), F.explode(F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(SPEAKS_OF)))).alias("line"))
    notices = lines.select("__key", F.explode(pieces(F.col("line"))).alias("piece")).select("__key", digest(F.col("piece")).alias("known_digest")).join(table, "known_digest").groupBy("__key").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    return whole.join(notices, "__key", "left").select(
        "doc_id", "digest", "license_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("notices"), F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_notices"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_ROWS = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
ORACLE = f"""
WITH known AS (SELECT sha256(c) AS dg, min(id) AS id FROM (SELECT id, {_sql_canonical("t")} AS c FROM (VALUES {_ROWS}) AS v(id, t)) WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
whole AS (SELECT rid, doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT rid, doc_id, {_sql_canonical("t")} AS c FROM d)),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d WHERE regexp_matches(t, '{SPEAKS_OF}')),
hit AS (SELECT DISTINCT rid, id FROM (SELECT rid, sha256({_sql_canonical("line")}) AS dg FROM lines WHERE regexp_matches(line, '{SPEAKS_OF}')) JOIN known USING (dg)),
listed AS (SELECT rid, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM hit GROUP BY rid)
SELECT doc_id, digest, known.id AS license_id, coalesce(ids, '') AS notices, coalesce(n, 0) AS n_notices FROM whole LEFT JOIN known ON digest = dg LEFT JOIN listed USING (rid)
"""
