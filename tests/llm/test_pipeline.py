"""The pipeline and the registered queries on a small folder of tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tablekit.llm import tokens
from tablekit.llm.queries import ORACLES, QUERIES

_WORDS = [a + b for a in "bra cle dor fen gul hap".split() for b in "sti mon lar pex".split()]
#: The columns that are agreed on; more may follow.
_CONTRACT = {
    1: "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    2: "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    3: "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    5: "doc_id:bigint held_out:boolean lang_pred:string score:double",
    9: "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    10: "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    11: "lang:string source:string part:string item:string value:bigint rank:int",
    12: "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    13: "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}


def _text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + rng.choice(_WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, _text(i, 60 + i % 50), "en" if i % 3 else "de", f"s{i % 4}" if i % 2 else "big") for i in range(60)]
    rows += [(100, _text(3, 63), "en", "big"), (101, _text(5, 65) + " more", "en", None), (102, _text(500, 80) + " " + _text(900, 14) + " end", None, "s1"),
             (103, "too short", "en", "big"), (104, None, None, None), (105, " ".join(["same words again"] * 40), "en", "s1"), (106, "", "de", "s2")]
    rows.append(rows[7])
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, _text(900, 14)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_in_a_row(spark, folder):
    from tokenizers import Tokenizer
    path, rows = folder
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    good = [r for r in rows if len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) >= 50 and r[0] not in (105,)]
    stay = [r for r in good if r[0] not in (100, 101, 102)]  # copies of 3 and 5, and the benchmark passage
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], (good, [r for r in good if r[0] not in (100, 101)], stay)):
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "hash"], name
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in expected), name
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=lambda r: r[1])
    assert {r[0] for r in got} == {r[0] for r in stay} and len(got) >= len(stay)
    text, start = {r[0]: r[1] for r in stay}, 0
    for doc_id, begin, n, crc in got:
        ids = whole.encode(text[doc_id], add_special_tokens=False).ids + [0]
        assert (begin, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_stages_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_their_columns(spark, folder, name):
    path, rows = folder
    out = QUERIES[name](spark, path)
    agreed = _CONTRACT.get(int(re.match(r"op(\d+)_", name)[1]), "doc_id:bigint").split()
    assert [f"{c}:{t}" for c, t in out.dtypes][:len(agreed)] == agreed
    if name != "op11_source_divergence":  # its rows are pairs and terms; it has tests of its own
        assert out.count() == len(rows)


def test_oracles_agree_on_the_small_folder(spark, folder):
    import duckdb
    path, rows = folder
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT DISTINCT * FROM '{path}/{table}.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        if name == "op11_source_divergence":  # counts repeated rows, which the views drop
            continue
        mine, theirs = QUERIES[name](spark, path), con.sql(sql)
        assert sorted({tuple(r) for r in mine.select(*theirs.columns).collect()}) == sorted(theirs.fetchall()), name
