"""Fill-in-the-middle against cuts made one line at a time."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablekit.llm.middles import fill_in_middle, restored

_SCHEMA = "doc_id long, text string, output int, n string, form int"
_TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "a\nb\nc", "ä\n中文\n😀\nß", "has <P> in it\nx", "x\n<M>", "<\nS>\n<S\n>", "é" * 3000 + "\n" + "y", "l\n" * 5000, "\r\n \x85\n"]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 7, t, 1, "x", 2) for i, t in enumerate(_TEXTS * 4)]
    return [*out, out[6], (None, "null\nid\ntext", None, None, None), (None, None, None, None, None)]


def _plainly(doc_id, text, marks):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_and_way_back(spark, rows):
    found = fill_in_middle(spark.createDataFrame(rows, _SCHEMA).repartition(3)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((r[0], *_plainly(r[0], r[1], ("<P>", "<S>", "<M>")), r[1] or "") for r in rows), key=str)
    assert sorted(map(tuple, found), key=str) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_units_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, "one two  three four", 1, "", 1) for i in range(60)] + [(99, "UPPER", 1, "", 1)], _SCHEMA)
    got = fill_in_middle(docs, unit=r"[a-z]+ *", fim_percent=50, spm_percent=0, marks=("[p]", "[s]", "[m]"))
    rows = {r.doc_id: r for r in got.withColumn("back", restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()}
    assert rows[99].n == 0 and rows[99].form == "plain"  # not covered by units
    forms = [rows[i].form for i in range(60)]
    assert {*forms} == {"plain", "psm"} and 15 <= forms.count("psm") <= 45
    assert all(rows[i].back == "one two  three four" and rows[i].n == 4 for i in range(60))
    assert {rows[i].prefix_chars for i in range(60) if rows[i].form == "psm"} <= {0, 4, 9, 15, 19}


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], _SCHEMA)).count() == 0
