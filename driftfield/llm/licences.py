"""License scans: entire texts looked up by canonical digest.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white space) and hashed; the digest is joined with those
of known licences and notices. Two kinds of entire texts are looked up: the document itself, and each of its lines, since notices stand
in documents as lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftfield.session import cut_lineage

#: Known texts: (licence, kind, text). Fixed values.
KNOWN = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
    ("ISC", "notice", "Released under the ISC License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("proprietary", "notice", "All rights reserved."),
    (
        "ISC", "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT", "text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
#: Spellings that mean the same, as words after case and punctuation are gone. Fixed values.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v2", "version 2"), ("v3", "version 3"), ("noncommercial", "nc"), ("organisation", "organization"), ("merchantibility", "merchantability"))
KNOWN_BROADCAST = 100_000
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
_OTHER = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """Lower case; copyright lines emptied; other characters than letters and digits are single spaces; spellings made equal; lines kept."""
    t = F.regexp_replace(F.lower(text), _COPYRIGHT.replace("(?m)", "(?md)"), "")
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, _OTHER, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return t


def _one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_licences(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence, kind, size), one row per canonical text; of texts that become equal the first by name counts. Empty ones are left out.

    ``known`` is a list like ``KNOWN`` or a table of the same columns (licence, kind, text).
    """
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame([tuple(k) for k in known], "licence string, kind string, text string")
    rows = rows.select("licence", "kind", _one_line(canonical_lines(F.col("text"))).alias("t")).where("t <> ''")
    return rows.groupBy(_digest(F.col("t")).alias("digest"), F.length("t").alias("size")).agg(F.min(F.struct("licence", "kind")).alias("m")).select("digest", "size", "m.*")


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, text_digest, licence, notices, n_notices) for every row of ``docs(doc_id, text)``.

    ``licence`` is the known licence that the entire text is, else null; ``notices`` the sorted distinct licences that whole lines of it are,
    comma-joined (empty without any), ``n_notices`` the number of such lines. Null text counts as empty, whose digest matches nothing.
    Repeated rows get equal results; an empty table or list is fine. ``known`` may be a table of texts, see ``known_licences``.
    """
    listed = known_licences(docs.sparkSession, known)
    sizes = [r["size"] for r in listed.select("size").distinct().collect()] or [-1]  # at most one per known text
    lines = canonical_lines(F.coalesce(F.col("text"), F.lit("")))
    split = docs.select("doc_id", lines.alias("lines"))
    fitting = F.filter(F.transform(F.split("lines", "\n"), lambda p: F.trim(p)), lambda p: F.length(p).isin(sizes))
    prepared = cut_lineage(split.select("doc_id", _digest(_one_line(F.col("lines"))).alias("text_digest"), fitting.alias("lines")))
    prepared = prepared.withColumn("row", F.md5(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("text_digest"), F.col("lines"))))
    few = (known.count() if isinstance(known, DataFrame) else len(known)) <= KNOWN_BROADCAST
    listed = F.broadcast(listed) if few else listed  # one row per known text
    found = prepared.select("row", F.posexplode("lines").alias("at", "line")).withColumn("digest", _digest(F.col("line"))).join(listed, "digest")
    found = found.select("row", "at", "licence").distinct().groupBy("row").agg(F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("notices"), F.count(F.lit(1)).alias("n_notices"))
    whole = listed.select(F.col("digest").alias("text_digest"), "licence")
    joined = prepared.drop("lines").join(whole, "text_digest", "left").join(found, "row", "left")
    return joined.select("doc_id", "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql() -> str:
    def lines(text: str) -> str:
        t = f"regexp_replace(lower({text}), '{_COPYRIGHT}', '', 'g')"
        t = f"' ' || replace(regexp_replace({t}, '{_OTHER}', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return t

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(t)})" for a, _, t in KNOWN)
    one = lambda t: f"trim(regexp_replace({t}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH texts(licence, text) AS (VALUES {known}),
known AS (SELECT sha256({one(lines('text'))}) AS digest, min(licence) AS licence FROM texts GROUP BY 1),
docs AS (SELECT doc_id, {lines("coalesce(text, '')")} AS t FROM documents),
digests AS (SELECT doc_id, t, sha256({one('t')}) AS text_digest FROM docs),
found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) JOIN known ON known.digest = sha256(trim(line)) GROUP BY doc_id
)
SELECT doc_id, text_digest, known.licence AS licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM digests LEFT JOIN known ON known.digest = text_digest LEFT JOIN found USING (doc_id)
"""


SQL = _sql()
