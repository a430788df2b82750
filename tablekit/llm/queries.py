"""The registered queries opN_<name>: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekit.llm.crossentropy import cross_entropy_difference
from tablekit.llm.divergence import source_divergence
from tablekit.llm.edits import cleaned_counts
from tablekit.llm.language import fit_coder, predict_language
from tablekit.llm.licenses import scan_licenses
from tablekit.llm.middles import fill_in_middle, restored
from tablekit.llm.minhash import near_duplicates
from tablekit.llm.mixing import mixture
from tablekit.llm.quality import quality_report
from tablekit.llm.secrets import secrets_report
from tablekit.llm.suffixes import contamination_report
from tablekit.llm.token_files import token_output
from tablekit.llm.toxicity import fit_chain, predict_chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_BARE_WORDS = r"'[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'"
_DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, {_BARE_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_folded('text')}, {_BARE_WORDS}) AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM i, unnest(range(1, len(w) - k + 2)) AS t(p)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS t(p)),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + k)) AS u(q) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
_NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p] || ' ' || w[p + 1] AS x FROM d, unnest(range(1, len(w))) AS t(p) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""

_MIDDLES_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_folded('text')} AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln, v.v, v.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (own + v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (ln + 1) // (total + v))::HUGEINT AS q FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 200"""


@_query("op9_token_files")
def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"))


@_query("op2_suffix_decontamination", _DECONTAMINATION_SQL)
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op3_minhash_near_duplicates", _NEAR_DUPLICATES_SQL)
def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=2)


@_query("op1_robust_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


@_query("op8_temperature_mixing")
def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


#: The labels table has two marks; the chain goes from low quality, whose cause often is junk, to toxic.
_CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


@_query("op4_toxicity_chain")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_chain(docs, fit_chain(docs, _table(spark, sf_dir, "labels"), _CATEGORIES))


@_query("op5_language_codes")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda name: F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(4)) == 2, F.lit(False))
    found = predict_language(docs, fit_coder(docs, ~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


@_query("op10_grammar_secrets")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(_table(spark, sf_dir, "documents"))


@_query("op7_cross_entropy_difference")
def _cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


@_query("op6_edited_token_counts")
def _edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_counts(_table(spark, sf_dir, "documents"))


@_query("op13_fill_in_middle", _MIDDLES_SQL)
def _middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@_query("op12_license_scan")
def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    joined = lambda name: F.array_join(name, ",").alias(name)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


@_query("op11_source_divergence", _DIVERGENCE_SQL)
def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))
