import os
import re
import textwrap

import pytest
from pyspark.sql import types as T

from rolecast.llm.license_texts import NOTICES, TEXTS, UNLICENSE
from rolecast.llm.licenses import scan_licenses

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("license_id", T.StringType()), T.StructField("digest", T.StringType())])


def test_texts_and_notices(spark):
    mit = dict(reversed(TEXTS))["MIT"]
    odd = "  COPYRIGHT (c) 2020 Some One\n© 1999 other\n(c) 2001 A B\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", "  , ").replace(" ", "\n ", 40)
    rows = [(1, mit), (2, odd), (3, mit + " and more"), (4, "Some text\n  released under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, None), (6, ""), (7, "Copyright 2020 me"), (None, "plain words"), (8, "word " * 50_000), (1, mit)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(TEXTS)] + [(200 + i, t) for i, (_, t) in enumerate(NOTICES)]
    out = scan_licenses(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert out.columns == ["doc_id", "canonical_sha256", "license_id", "n_notices", "notices"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["license_id"] for i in (1, 2, 3, 4)] == ["MIT", "MIT", None, None]
    assert by[1]["canonical_sha256"] == by[2]["canonical_sha256"]
    assert (by[4]["n_notices"], by[4]["notices"]) == (3, "CC-BY-NC-4.0,MIT")
    assert [by[i]["canonical_sha256"] for i in (5, 6, 7)] == [None] * 3 and by[None]["notices"] == ""
    assert [by[100 + i]["license_id"] for i in range(len(TEXTS))] == [n for n, _ in TEXTS]
    assert [by[200 + i]["notices"] for i in range(len(NOTICES))] == [n for n, _ in NOTICES]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_own_texts(spark):
    extra = spark.createDataFrame([("House-1", "Use it as you like.", 3)], "license_id string, text string, n int")
    out = scan_licenses(spark.createDataFrame([(1, "use it, as YOU like", "", "")], SCHEMA), extra=extra).collect()
    assert out[0]["license_id"] == "House-1"


def wrapped(text, width):
    return "\n\n".join(p if re.search(r"(?im)^\s*copyright (\(c\)|\[)", p) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))


def test_hard_wraps_change_nothing(spark):
    head = "Copyright (c) 1998-2004 A. Holder\nCopyright The Project Authors\ncopyright jane doe\nCopyright A Rather Long List Of Holders, With Many Names, 1999\nAll rights reserved.\n\n"
    rows = [(i, head + wrapped(t, w), n, None) for w in range(12, 101) for i, (n, t) in enumerate([*TEXTS, *UNLICENSE])]
    assert any(line.lower().startswith("copyright notice and this permission") for _, t, *_ in rows for line in t.split("\n"))
    names = [n for n, _ in [*TEXTS, *UNLICENSE]]
    assert [(r["doc_id"], r["license_id"]) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect() if r["license_id"] != names[r["doc_id"]]] == []


def test_body_lines_are_not_statements(spark):
    mit = dict(reversed(TEXTS))["MIT"]
    rows = [(1, mit + "\ncopyright notices may be removed", None, None), (2, mit + "\nAll rights reserved except these.", None, None), (3, mit + "\nCopyright holders owe you a beer.", None, None)]
    assert [r["license_id"] for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()] == [None] * 3


@pytest.mark.parametrize("width", [60, 72, 79])
def test_long_licenses(spark, width):
    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all(os.path.exists(f"{folder}/{n}") for n in names):
        pytest.skip("no licence texts on this machine")
    texts = [open(f"{folder}/{n}", encoding="utf-8").read() for n in names]
    rows = [(i, t, None, None) for i, x in enumerate(texts) for t in (x, wrapped(x, width))]
    assert [r["license_id"] for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()] == [n for n in names.values() for _ in (1, 2)]
