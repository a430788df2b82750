"""License scans against a plain search, on texts with notices, edited wordings and awkward rows."""

from __future__ import annotations

import random
import re

import pytest

from tablekit.llm import licenses
from tablekit.llm.licenses import PHRASES, TEMPLATES, scan_licenses

_SCHEMA = "doc_id long, text string, label int, spans string, key string, runs int"
_LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def _prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(_LOREM) for _ in range(n)]


def _bare(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _places(text):
    own = _bare(text)
    return [(i, label) for phrase, label in PHRASES for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]


_MIT = dict(enumerate(t for label, t in TEMPLATES if label == "mit"))[2]


def _edited(words: list[str], every: int) -> str:
    """Some words replaced, some left out, some added."""
    out = []
    for i, w in enumerate(words):
        out += [["odd"], [], [w, "more"]][i // every % 3] if i % every == every - 1 else [w]
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    whole = _MIT.split()
    texts = [None, "", " .,! ", "one", "MIT license", "the mit License\n-- CC  by,nc", "gnu general public license gnu general public license", " ".join(_prose(1, 50)) + " " + _MIT,
             " ".join(_prose(2, 30) + [_edited(whole, 12)] + _prose(3, 30)), " ".join(whole[:20]), " ".join(random.Random(5).sample(whole, len(whole))),
             "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-ND 4.0.", "Released under the MIT License. " * 400, " ".join(_prose(4, 60000)) + " Licensed under the Apache License, Version 2.0",
             f"{_MIT} and {_edited(whole, 15)}", "Äpache license ÉMIT license 许可 mit license"]
    out = [(i, t, 1, "s", "k", 3) for i, t in enumerate(texts)]
    return [*out, out[7], (None, texts[7], 1, "s", "k", 3), (None, texts[7], 1, "s", "k", 3), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def found(spark, rows):
    return scan_licenses(spark.createDataFrame(rows, _SCHEMA).repartition(3)).collect()


def test_phrases_at_every_place(rows, found):
    want = sorted((str(r[0]), len(_bare(r[1])), len(p), min(p, default=(None,))[0], max(p, default=(None,))[0], sorted({x[1] for x in p})) for r in rows for p in [_places(r[1])])
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in want]
    assert [x[3:5] for x in got] == [x[3:5] for x in want]


def test_wordings_are_found_where_they_stand(found):
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    n = len(_bare(_MIT))
    assert [(s.label, s["first"], s.last, s.score) for s in by[7].spans] == [("mit", 50, 50 + n, 1.0)]
    (span,) = by[8].spans
    assert span.label == "mit" and span["first"] == 30 and 0.75 <= span.score < 1 and abs(span.last - 30 - n) <= 6
    assert not by[9].spans and not by[10].spans and by[9].score == 0  # an excerpt, and the same words in another order
    assert by[11].labels == ["cc-by", "cc-by-nc-4.0"] and by[12].labels == ["cc-by"]
    assert len(by[13].spans) == 400 == by[13].n_base and {s.label for s in by[13].spans} == {"mit"}
    assert [(s.label, s["first"]) for s in by[14].spans] == [("apache-2.0", 60000)]
    assert [s["first"] for s in by[15].spans] == [0, n + 1]
    nulls = [r for r in found if r.doc_id is None]
    assert sorted(len(r.spans) for r in nulls) == [0, 1, 1] and all(0 <= r.score <= 1 for r in found)


def test_templates_in_rounds(spark, rows, found, monkeypatch):
    monkeypatch.setattr(licenses, "JOINED_AT_ONCE", 100)
    again = scan_licenses(spark.createDataFrame(rows, _SCHEMA).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty_table_and_no_templates(spark, rows):
    assert scan_licenses(spark.createDataFrame([], _SCHEMA)).count() == 0
    got = scan_licenses(spark.createDataFrame(rows, _SCHEMA), templates=()).collect()
    assert all(r.labels == r.base_labels and not r.spans for r in got) and len(got) == len(rows)
    with pytest.raises(ValueError):
        scan_licenses(spark.createDataFrame(rows, _SCHEMA), templates=[("x", "too short")])
