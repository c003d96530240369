"""Licence texts recognised by the digest of their canonical form.

Canonical form: lower case, copyright lines left out, everything but letters,
digits and line ends turned into single blanks, equivalent spellings made one.
The digest of a whole text, and of each of its lines for short notices, is joined
with the digests of known licences.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import without

# Texts and usual notices of licences, by SPDX name.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
}
#: Whole lines that name a holder, and spellings that count as one.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|all rights reserved|©|&copy;|\(c\)[^\n]*(19|20)[0-9][0-9]|\(c\)[ \t]*[<\[{](year|yyyy))[^\n]*"
SPELLINGS = [("licenc", "licens"), ("(organi|authori|recogni)s(e|a|i)", r"\1z\2"), ("non infringement", "noninfringement")]


#: Where the terms of a text end and hints on how to apply them begin.
HINTS = r"(?i)\n[ \t]*(appendix: )?how to apply (these terms|the apache license)[^\n]*\n"
#: A first line that names the licence and is often left out.
TITLE = r"\A\s*[^\n]{0,40}licen[cs]e\s*\n"
#: Texts whose title is their name only; that of others is part of the text.
UNTITLED = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")


def references() -> list[tuple[str, str]]:
    """(licence, text) of `licence_texts`, the whole texts that come with this package: with and without hints on use."""
    made = []
    for file in sorted(resources.files("meterloom.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
            made += [(name, text), (name, re.split(HINTS, text)[0])]
    return made


def known(spark: SparkSession) -> DataFrame:
    """`licence`, `text` of the licences this module names and of the whole texts that come with it."""
    rows = [(k, t) for k, texts in KNOWN.items() for t in texts] + references()
    rows += [(k, re.sub(TITLE, "", t, flags=re.I)) for k, t in rows if k in UNTITLED and "\n" in t]
    return spark.createDataFrame(sorted(set(rows)), "licence string, text string")


def canonical(text: str | Column) -> Column:
    """The canonical form with its line ends; null for null."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    out = F.regexp_replace(out, "[^a-z0-9\n]+", " ")
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one.replace("\\", "$"))
    return out


def _whole(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, "[ \n]+", " "))


def scan(docs: DataFrame, licences: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`doc_id`, `line` (0: the whole text, else the line's number from 1), `licence`, `digest`.

    One row for every whole text and every line whose canonical form is that of
    a known licence. Null texts and units without letters or digits match
    nothing; repeated rows give repeated rows; a licence listed twice counts
    once.
    """
    form = canonical(text_col)
    units = F.concat(F.array(_whole(form)), F.transform(F.split(form, "\n"), lambda x: F.trim(x)))
    rows = without(docs.select(id_col, text_col), ["line"]).where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(units).alias("line", "unit")).where("unit <> ''")
    digests = licences.select("licence", F.sha2(_whole(canonical("text")), 256).alias("digest")).distinct()
    return rows.select("doc_id", "line", F.sha2("unit", 256).alias("digest")).join(digests, "digest").select("doc_id", "line", "licence", "digest")
