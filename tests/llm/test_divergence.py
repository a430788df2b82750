"""The source divergence audit against plain counting, and the pointer sort against sorted()."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablekit.llm import divergence
from tablekit.llm.divergence import source_divergence, sorted_pointers

_SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, rank int"


def _plainly(rows, least=3, shown=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if df[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pair = [(-sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h.encode(), h) for h in counts if h != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:shown])):
                out += [(lang, s, part, name, -value, i) for i, (value, _, name) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "Ko", "é", "longerword", "longerwordsthatgoon") for b in ("", "ra", "x", "中") for c in ("", "s", "ing")]
    out = []
    for i in range(260):
        some = rng.sample(vocabulary, 12)
        text = " ".join(rng.choice(some) + rng.choice(["", ",", "1", "-x"]) for _ in range(rng.randrange(0, 40)))
        out.append((i, text, "en" if i < 200 else "de", f"s{rng.randrange(70) if i < 200 else rng.randrange(3)}", "t", 1, 2))
    out += [(900 + i, "hot word " * 40, "en", "s1", "t", 1, 2) for i in range(30)]  # copies
    return [*out, (1, None, "en", "nothing", None, None, None), (2, "alone", "xx", "only", None, None, None), (None, "ba ba Ba", None, None, None, None, None), (None, "BA", None, "é", None, None, None),
            (5, "x" * 20000 + " ba" * 5000, "en", "s2", None, None, None), (6, " 123 .", "fr", "b", None, None, None), (7, "", "fr", "a", None, None, None)]


def test_audit_equals_plain_counting(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, _SCHEMA).repartition(5)
    want = _plainly(rows)
    assert sorted(map(tuple, source_divergence(docs).collect())) == want
    assert {r[2] for r in want} == {"pair", "term"} and len({r[1] for r in want if r[0] == "en"}) > divergence.SOURCES_AT_ONCE
    monkeypatch.setattr(divergence, "GROUP_ROWS", 40)  # many buckets of terms
    monkeypatch.setattr(divergence, "SHARD_BYTES", 500)
    assert sorted(map(tuple, source_divergence(docs).collect())) == want


def test_ranks_and_bounds(spark, rows):
    docs = spark.createDataFrame(rows, _SCHEMA)
    assert sorted(map(tuple, source_divergence(docs, least_documents=1, terms_shown=4).collect())) == _plainly(rows, 1, 4)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], _SCHEMA)).count() == 0


def test_pointer_sort():
    rng = random.Random(3)
    words = [("abcdefgh" * rng.randrange(0, 4) + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 10)))).encode() for _ in range(3000)]
    words += [b"a" * 7, b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17, "é中".encode()] * 3
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    order, new = sorted_pointers(data, starts, ends)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i])  # equal words keep their order
    own = [words[i] for i in order]
    assert new.tolist() == [i == 0 or own[i] != own[i - 1] for i in range(len(own))]
    assert not len(sorted_pointers(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))[0])
