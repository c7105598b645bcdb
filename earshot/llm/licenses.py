"""License scans: canonical digests of entire texts, looked up among known licences.

A text is made canonical (lower case, equivalent spellings made one, copyright lines removed, every
run of other characters than letters and digits one space) and digested to 128 bits. Digests of
whole documents and of their whole lines are joined to the digests of known texts; a part of a
line never matches.

A null or empty text has no digest and matches nothing, nor does a text or line of which the
canonical form is empty. Several known texts may have one digest; the smallest name answers. Rows
that repeat a ``doc_id`` are answered together. An empty table gives no rows, and other columns
are ignored.

Scale: canonical texts stay inside their row; only digests meet the known texts, and only matches
are shuffled, summed by document. No hint is given: the planner broadcasts the known table when
its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import stored, text_or_empty

#: Lines that name a copyright holder.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9<\[{]|by )[^\n]*"

#: Spellings that mean the same in a licence.
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "copyright owner": "copyright holder",
    "per cent": "percent",
    "whilst": "while",
    "favour": "favor",
    "http:": "https:",
    "&": "and",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {terms}"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: (name, text): licences and the notices by which texts name one.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("ISC", _ISC.format(terms=_AS_IS)),
    ("0BSD", _ISC.format(terms=_AS_IS).replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    ("proprietary", "All rights reserved"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty ones."""
    plain = F.lower(text)
    for other, one in SPELLINGS.items():
        plain = F.replace(plain, F.lit(other), F.lit(one))
    plain = F.regexp_replace(plain, COPYRIGHT_LINE, "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``digest, license`` of the known texts: (name, text) pairs or a table of ``license, text``."""
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(texts or KNOWN, "license string, text string")
    whole = F.array_join(canonical_lines(text_or_empty()), " ")
    digests = texts.select("license", whole.alias("whole")).filter("whole != ''")
    return digests.groupBy(_digest(F.col("whole")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, license, line_licenses, n_license_lines`` for every document.

    ``license`` is that of the entire text or null, ``line_licenses`` the names whose text is a
    whole line (ordered, joined by commas) and ``n_license_lines`` the number of such lines.
    """
    known = stored(known_digests(docs.sparkSession) if known is None else known, "license-digests")
    lines = docs.select("doc_id", canonical_lines(text_or_empty()).alias("lines"))
    digests = stored(
        lines.select(
            "doc_id",
            F.when(F.size("lines") > 0, _digest(F.array_join("lines", " "))).alias("whole"),
            F.transform("lines", _digest).alias("lines"),
        ).select(
            "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("entire"), F.col("whole").alias("digest"))),
            F.transform("lines", lambda d: F.struct(F.lit(False).alias("entire"), d.alias("digest"))))).alias("at"),
        ).select("doc_id", "at.entire", "at.digest")
        .join(known.select("digest", "license"), "digest", "left")
        .filter(F.col("entire") | F.col("license").isNotNull())
        .select("doc_id", "entire", "license"),
        "license-matches",
    )
    by_line = F.col("license").isNotNull() & ~F.col("entire")
    return digests.groupBy("doc_id").agg(
        F.min(F.when(F.col("entire"), F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(by_line, F.col("license")))), ",").alias("line_licenses"),
        F.count_if(by_line).alias("n_license_lines"),
    )
