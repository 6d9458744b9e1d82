r"""License scans by canonical digests, with DataFrame functions only.

A text is canonical when its case, its copyright lines, its punctuation and spellings that mean the same
are made alike.  The digest of the whole canonical text is looked up in a table of known licenses by an
equi-join; so is that of every line, since licenses are often stated in one.  Nothing is searched
inside a line or text: a text that merely mentions a license does not have its digest.

The public licenses are data, in known_licenses.jsonl: each text is known with and without its titles, with
numbers or bullets, in its own and in other line widths, since a line that begins with "copyright" is no part
of a canonical text; so are short notices by each of its names.

Defined results: a NULL or empty text has no license; rows that share an id are one document; a table that
knows nothing finds nothing; digests that several known licenses share name the least of them; extra
columns are not looked at.
"""

from __future__ import annotations

import json
import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and whole texts of public licenses, by their usual short names.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."
    )),
)
# Spellings that mean the same.
SPELLINGS = (("licence", "license"), ("&", " and "), ("favour", "favor"), ("organisation", "organization"), ("non-infringement", "noninfringement"))

_COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Short notices of a license's name, with and without its article.
NOTICE_FORMS = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This project is licensed under {}.", "This work is licensed under {}.",
    "This software is licensed under {}.", "This software is released under {}.", "This code is licensed under {}.",
    "This project is licensed under {} - see the LICENSE file for details.", "This project is licensed under {} - see the LICENSE.md file for details.",
)
_MARKER = r"(?m)^[ \t]*(?:[0-9]+\.|\([a-z]\)|[*-])[ \t]"


def _wrapped(text: str) -> list[str]:
    """The text as it is and in the line widths that make another canonical text of it; long texts in the usual widths."""
    long = len(text) >= 2_000
    joined = [re.sub(r"\s+", " ", x).strip() for x in re.split(r"\n[ \t]*\n|\n(?=[ \t]*(?:[0-9]+\.|\([a-z]\)|[*-])[ \t])", text)]
    forms = {tuple(m[0].strip() for m in re.finditer(_COPYRIGHT, text.lower())): text}
    for width in (10**9, *((72, 78, 80) if long else range(56, 121))):
        for indent in (0,) if long else (0, 2, 3, 4):
            lines = [
                x if not re.search(r"copyright|\(c\)|©", x.lower())
                else "\n".join(textwrap.wrap(x, width - indent * bool(re.match(_MARKER, x)), break_long_words=False, break_on_hyphens=False))
                for x in joined
            ]
            form = "\n\n".join(lines)
            forms.setdefault(tuple(m[0].strip() for m in re.finditer(_COPYRIGHT, form.lower())), form)
    return list(forms.values())


def known_licenses() -> list[tuple[str, str]]:
    """``license, text`` of the fixed notices and of the data file."""
    found = dict.fromkeys(NOTICES)
    for line in Path(__file__).with_name("known_licenses.jsonl").read_text(encoding="utf-8").splitlines():
        own = json.loads(line)
        name, text = own["license"], own["text"]
        # Of lists of conditions only; longer texts refer to their sections by number.
        bullets = {text, re.sub(r"(?m)^[ \t]*[0-9]\. ", "* ", text)} if name.startswith("BSD") else {text}
        linked = {x.replace(*way) for x in bullets for way in (("http://", "http://"), ("http://", "https://"), ("https://", "http://"))}
        rights = ("", "All rights reserved.\n\n") if len(text) < 2_000 else ("",)
        for body in (form for x in sorted(linked) for form in _wrapped(x)):
            for title in ("", *own["titles"]):
                found.update(dict.fromkeys((name, f"{title}\n\n{right}{body}") for right in rights))
        called = [f"{the}{x}" for x in own["names"] for the in ("the ", "")]
        found.update(dict.fromkeys((name, form.format(x)) for form in NOTICE_FORMS for x in called))
        found[name, f"SPDX-License-Identifier: {name}"] = None
        if "GPL" in name:
            found.update(dict.fromkeys((name, f"SPDX-License-Identifier: {name}{end}") for end in ("-only", "-or-later", "+")))
    return list(found)


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), _COPYRIGHT, "\n")
    for found, wanted in SPELLINGS:
        plain = F.replace(plain, F.lit(found), F.lit(wanted))
    return F.trim(F.regexp_replace(plain, _PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """Hexadecimal SHA-256 of the canonical text, NULL when nothing is left of it."""
    plain = canonical(text)
    return F.when(plain != "", F.sha2(plain, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """``license, text`` as ``digest, license``."""
    return known.select(digest(F.col("text")).alias("digest"), "license").where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(documents: DataFrame, known: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: lines, the license its whole text is, how many lines are one, and all found."""
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col(text).alias("text")))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    units = documents.select(F.col(doc).alias("doc"), F.explode(F.concat(whole, lines)).alias("u")).select("doc", "u.whole", digest(F.col("u.text")).alias("digest"))
    found = units.join(known_digests(known), "digest", "left")
    is_line = ~F.col("whole")
    return found.groupBy("doc").agg(
        F.count(F.when(is_line & F.col("digest").isNotNull(), 1)).alias("n_lines"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.count(F.when(is_line & F.col("license").isNotNull(), 1)).alias("n_license_lines"),
        # At most as many as are known.
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    ).withColumnRenamed("doc", doc)


QUERY = "op9_licenses"


def query(spark, folder: str) -> DataFrame:
    known = spark.createDataFrame(known_licenses(), "license string, text string")
    return scan_licenses(spark.read.parquet(f"{folder}/documents.parquet"), known)


# The twin knows the fixed notices only, so it holds where no other known license occurs.
def _canonical_sql(text: str) -> str:
    sql = rf"regexp_replace(translate({text}, '{_UPPER}', '{_UPPER.lower()}'), '{_COPYRIGHT}', chr(10), 'g')"
    for found, wanted in SPELLINGS:
        sql = f"replace({sql}, '{found}', '{wanted}')"
    return rf"trim(regexp_replace({sql}, '{_PUNCTUATION}', ' ', 'g'))"


ORACLE = f"""
with known as (
  select sha256({_canonical_sql("text")}) as digest, min(license) as license
  from (values {", ".join("('" + n + "', '" + t + "')" for n, t in NOTICES)}) k(license, text) group by 1
),
units as (
  select doc_id, false as whole, unnest(string_split(coalesce(text, ''), chr(10))) as text from documents
  union all select doc_id, true, text from documents
),
d as (select doc_id, whole, {_canonical_sql("text")} as plain from units),
f as (select doc_id, whole, nullif(plain, '') as plain, license from d left join known on plain <> '' and digest = sha256(plain))
select doc_id, count(*) filter (not whole and plain is not null)::bigint as n_lines,
  min(license) filter (whole) as text_license,
  count(license) filter (not whole)::bigint as n_license_lines,
  coalesce(string_agg(distinct license, ',' order by license), '') as licenses
from f group by doc_id
"""
