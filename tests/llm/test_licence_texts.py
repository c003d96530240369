"""Whole licence texts with varied holder lines."""

import re

import pytest

from meterloom.llm import licenses

HOLDERS = ["Copyright (c) 2020 Jane Doe", "(c) 2020 Jane Doe", "(C) Jane Doe, 1999-2004", "© Jane Doe", "   Copyright 2011 The Authors. All rights reserved."]
NAMES = {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}


def test_whole_texts_with_varied_holders(spark):
    texts = dict(licenses.references()[::-1]) | {k: licenses.KNOWN[k][-1] for k in ("MIT", "ISC")}
    assert NAMES <= set(texts)
    rows = []
    for name, text in texts.items():
        rows += [(name, f"{h}\n\n{text}") for h in HOLDERS]
        if "<year> <holder>" in text:
            rows += [(name, text.replace("Copyright (c) <year> <holder>", h)) for h in HOLDERS]
            rows.append((name, re.sub(r"^.*\n", "", text, count=1)))
    rows.append(("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r["doc_id"], r["licence"]) for r in licenses.scan(docs, licenses.known(spark)).where("line = 0").collect()}
    assert got == {(i, name) for i, (name, _) in enumerate(rows)}


@pytest.mark.parametrize("item", ["(c) You must retain all notices", "(c) you may not"])
def test_list_items_are_no_copyright_lines(spark, item):
    row = spark.createDataFrame([(item,)], "t string").select(licenses._whole(licenses.canonical("t")).alias("w")).first()
    assert row["w"].startswith("c you")
