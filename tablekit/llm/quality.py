"""Quality rules: counted text statistics, and robust outliers by minimum-covariance-determinant estimates per group.

Columns and SQL functions only. The statistics of a text are array expressions over its words; the estimates work on a table
of rounded statistic vectors per group, each with the number of different texts that have it, so a group of any size shrinks
before its rows meet. Exact copies of a text are folded by its hash before that and cannot outvote other documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.plans.skew import equi_join
from tablekit.llm.work import text_columns, without, written

#: The white space of the word rule, and the symbols that are counted.
_SPACE, _SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The statistic vector: (expression, rounding step, least spread). The logarithms make ratios comparable; a spread below the
#: least one (a statistic that is 0 in most texts) counts as the least one, so a single line or symbol rejects nothing.
STATISTICS = (
    ("ln(n_words)", 1 / 16, 0.25),
    ("ln(word_chars / n_words)", 1 / 64, 0.05),
    ("ln(1 + 100 * n_symbols / word_chars)", 1 / 16, 0.25),
    ("ln(1 + 100 * n_dup_lines / n_words)", 1 / 16, 0.5),
    ("ln(1 + 100 * n_repeat_words / n_words)", 1 / 16, 1.0),
)
_P = len(STATISTICS)
_X = [f"x{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
#: Share of a group's vectors that the determinant is minimised over, and C-steps from each start.
COVERAGE, STEPS = 0.75, 5
#: Texts at which a group's own estimate weighs as much as that of what it belongs to: a source to its language, that to the corpus, and the corpus
#: to spreads as wide as `PRIOR`.
SHRINK = 200.0
PRIOR = (2.0, 0.5, 2.0, 2.0, 2.5)
#: Quantiles 0.5, 0.8 and 0.975 of the chi-squared distribution with 5 degrees of freedom.
_CHI2_MEDIAN, _CHI2_UPPER, _CHI2_WEIGHT = 4.3515, 7.2893, 12.8325
#: Squared distance up to which a document always stays (the 0.9999 quantile of normal data is 25.7), and the share of a
#: language's documents that may lie beyond the cutoff by the tail that its distances have.
CUTOFF, TAIL = 60.0, 1e-3
#: Groups whose estimates are sent to all tasks; with more, the join splits hot ones.
_BROADCAST_GROUPS = 50_000
_BUCKETS = 32  # to a unit of ln(d2): distances are ranked to 3 %


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and text_hash of every whole text."""
    own = text_columns(docs, "doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), F.expr(rf"array_remove(split(text, r'{_SPACE}', -1), '')").alias("w"),
                     F.expr(f"cast(regexp_count(text, '{_SYMBOLS}') as long)").alias("n_symbols"),
                     F.expr(r"filter(split(text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')").alias("lines"))
    own = own.select(
        "doc_id", "lang", "source", "text_hash", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # One hash per window of three words; equal windows have equal hashes.
        F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))").alias("h"))
    own = own.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end"))
    own = own.withColumn("p", F.expr("sort_array(transform(filter(s, (e, j) -> get(s, j - 1).h = e.h or get(s, j + 1).h = e.h), e -> e.i))"))
    # Windows at p cover p, p + 1, p + 2; the next one takes over where it begins.
    repeat = F.expr("coalesce(aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)")
    own = own.withColumn("n_repeat_words", repeat).drop("h", "s", "p")
    return own.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def _moments(n: Column, of: callable) -> list[Column]:
    return [n.alias("n"), *(of(F.col(_X[i])).alias(f"s{i}") for i in range(_P)), *(of(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _weighted() -> list[Column]:
    """The moments of all texts, where `k` texts have a vector."""
    return _moments(F.sum("k"), lambda x: F.sum(F.col("k") * x))


def _fitted(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Means, the inverse Cholesky factor and ln of the determinant, from counts and sums of values and products."""
    out = sums.select(*keep, "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS))
    out = out.select(*keep, "n", *(f"m{i}" for i in range(_P)), *(
        (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in _PAIRS))
    return _factored(out)


def _factored(out: DataFrame, ridge: bool = True) -> DataFrame:
    """From columns m (means) and c (covariances): the ridge, the Cholesky factor column by column, its inverse v row by row. The
    covariances with the ridge stay as w."""
    if ridge:
        out = out.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + F.lit(STATISTICS[i][2] ** 2) for i in range(_P)})
    out = out.withColumns({f"w{i}{j}": F.col(f"c{i}{j}") for i, j in _PAIRS})
    for j in range(_P):
        diagonal = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-9))))
        if j + 1 < _P:
            out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, _P)})
    for i in range(_P):
        row = {f"v{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            row[f"v{i}{j}"] = -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
        out = out.withColumns(row)
    out = out.withColumn("ln_det", sum((2 * F.ln(f"l{i}{i}") for i in range(_P)), F.lit(0.0)))
    return out.drop(*(f"{x}{i}{j}" for x in "cl" for i, j in _PAIRS))


def _distance() -> Column:
    rows = [sum((F.col(f"v{i}{j}") * (F.col(_X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(_P)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _by_bucket(cells: DataFrame, fits: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Counts and sums of each group by bucket of the distance, and how many texts lie up to there and altogether."""
    fits = fits.drop("n")
    dealt = cells.join(fits, on).withColumn("bucket", F.floor(_BUCKETS * F.ln(_distance() + F.lit(1e-6))))
    sums = dealt.groupBy(*keys, "bucket").agg(*_weighted())
    inside = Window.partitionBy(*keys)  # at most a few hundred buckets a group
    return sums.withColumns({"upto": F.sum("n").over(inside.orderBy("bucket")), "all": F.sum("n").over(inside)})


def _refit(buckets: DataFrame, keys: list[str]) -> DataFrame:
    added = buckets.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS)]))
    return _fitted(added, keys)


def _starts(cells: DataFrame) -> DataFrame:
    """Three deterministic starts per group: all texts; medians with absolute deviations; medians with spatial signs."""
    whole = _fitted(cells.groupBy("g").agg(*_weighted()), ["g"]).withColumn("start", F.lit(0))
    medians = written(cells.groupBy("g").agg(F.sum("k").alias("n"), *(F.expr(f"percentile({x}, 0.5, k)").alias(f"m{i}") for i, x in enumerate(_X))), "medians")
    off = cells.join(medians, "g")
    spread = off.groupBy("g").agg(*(F.expr(f"percentile(abs({x} - m{i}), 0.5, k)").alias(f"d{i}") for i, x in enumerate(_X)))
    spread = written(medians.join(spread, "g").withColumns({f"d{i}": F.greatest(F.col(f"d{i}") * F.lit(1.4826), F.lit(STATISTICS[i][2])) for i in range(_P)}), "spreads")
    diagonal = spread.select("g", "n", *(f"m{i}" for i in range(_P)), *((F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    z = cells.join(spread, "g")
    for i, x in enumerate(_X):
        z = z.withColumn(f"z{i}", (F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}"))
    z = z.withColumn("norm", F.greatest(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P)]), F.lit(1e-6)))
    signs = z.groupBy("g").agg(F.sum("k").alias("n"), *(F.first(f"{k}{i}").alias(f"{k}{i}") for k in "md" for i in range(_P)),
                               *((F.sum(F.col("k") * F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") * _P) / F.sum("k")).alias(f"u{i}{j}") for i, j in _PAIRS))
    signs = signs.select("g", "n", *(f"m{i}" for i in range(_P)), *((F.col(f"u{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in _PAIRS))
    return whole.unionByName(_factored(diagonal).withColumn("start", F.lit(1))).unionByName(_factored(signs).withColumn("start", F.lit(2)))


def robust_fits(vectors: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """The estimate of each group g of `vectors` (g, text_hash, x0 ...): means m, inverse factor v, and `scale` of squared
    distances.

    Each different text counts once, also where rounded vectors are equal. From every start, C-steps keep the texts nearest to
    the last estimate until they make up `coverage` of the group; the estimate of least determinant wins and is refitted on all texts within the
    0.975 quantile. `scale` makes the median squared distance that of normal data.
    """
    step = [F.round(F.col(x) / F.lit(s[1])) * F.lit(s[1]) for x, s in zip(_X, STATISTICS)]
    texts = vectors.select("g", "text_hash", *(c.alias(x) for c, x in zip(step, _X))).distinct()
    return _estimates(written(texts.groupBy("g", *_X).agg(F.count("*").alias("k")), "vectors"), coverage, steps)


def _estimates(cells: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """`robust_fits` of a written table of g, rounded vectors and the number k of texts of each; also the covariances w."""
    fits = written(_starts(cells), "starts")
    for _ in range(steps):
        buckets = _by_bucket(cells, fits, ["g", "start"], ["g"]).where(F.col("upto") - F.col("n") < F.ceil(F.lit(coverage) * F.col("all")))
        fits = written(_refit(buckets, ["g", "start"]), "c-step")
    best = fits.groupBy("g").agg(F.min(F.struct("ln_det", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    fits = written(fits.join(best, ["g", "start"]).drop("start", "ln_det"), "best")
    scaled = _scaled(written(_by_bucket(cells, fits, ["g"], ["g"]), "distances"))
    near = scaled.where(F.exp(F.col("bucket") / F.lit(float(_BUCKETS))) <= F.col("scale") * F.lit(_CHI2_WEIGHT)).drop("scale")
    fits = written(_refit(near, ["g"]).drop("ln_det"), "reweighted")
    scale = _scaled(_by_bucket(cells, fits, ["g"], ["g"])).select("g", "scale").distinct()
    return written(fits.join(scale, "g").drop("n"), "fits")


def _scaled(buckets: DataFrame) -> DataFrame:
    middle = F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bucket"))).over(Window.partitionBy("g"))
    return buckets.withColumn("scale", F.exp((middle + 0.5) / F.lit(float(_BUCKETS))) / F.lit(_CHI2_MEDIAN))


def _shrunk(own: DataFrame, parent: tuple[dict, dict], weight: Column) -> DataFrame:
    """Means m and covariances w (times scale) of a group, drawn towards those of its parent (columns of the same row), which weigh 1 - weight. The
    distance between the means adds to the spread."""
    means = {f"m{i}": weight * F.col(f"m{i}") + (1 - weight) * parent[0][i] for i in range(_P)}
    off = [F.col(f"m{i}") - parent[0][i] for i in range(_P)]
    covariances = {f"w{i}{j}": weight * F.col("scale") * F.col(f"w{i}{j}") + (1 - weight) * parent[1][i, j] + weight * (1 - weight) * off[i] * off[j] for i, j in _PAIRS}
    return own.withColumns({**means, **covariances}).withColumn("scale", F.lit(1.0))


def _levels(base: DataFrame) -> DataFrame:
    """The shrunk estimate of every language l and source r: l, r, n (texts), l_n (of the language), m, v.

    `base` has l, r, rounded vectors and the number k of different texts that have each. Estimates are made for sources, languages and the corpus at once.
    """
    name = F.to_json(F.struct("l", "r")), F.to_json(F.struct("l")), F.lit("{}")
    cells = [base.withColumn("g", g).groupBy("g", *_X).agg(F.sum("k").alias("k")) for g in name]
    fits = _estimates(written(cells[0].unionByName(cells[1]).unionByName(cells[2]), "levels"))
    sizes = base.groupBy("l", "r").agg(F.sum("k").alias("n"))
    sizes = sizes.withColumns({"l_n": F.sum("n").over(Window.partitionBy("l")), "g": name[0], "l_g": name[1], "all_g": name[2]})
    total = sizes.agg(F.sum("n").alias("all_n"))
    kept = ["scale", *(f"m{i}" for i in range(_P)), *(f"w{i}{j}" for i, j in _PAIRS)]
    weight = lambda n: F.col(n) / (F.col(n) + SHRINK)
    of = lambda prefix: ({i: F.col(f"{prefix}m{i}") for i in range(_P)}, {p: F.col(f"{prefix}w{p[0]}{p[1]}") for p in _PAIRS})
    under = lambda df, prefix: df.select(F.col("g").alias(f"{prefix}g"), *(F.col(c).alias(f"{prefix}{c}") for c in kept if c != "scale"))
    prior = ({i: F.col(f"m{i}") for i in range(_P)}, {(i, j): F.lit(PRIOR[i] ** 2 if i == j else 0.0) for i, j in _PAIRS})
    whole = fits.where("g = '{}'").select("g", *kept).join(total)
    whole = _shrunk(whole, prior, weight("all_n"))
    langs = fits.select("g", *kept).join(sizes.select(F.col("l_g").alias("g"), "l_n", "all_g").distinct(), "g").join(under(whole, "all_"), "all_g")
    langs = _shrunk(langs, of("all_"), weight("l_n"))
    own = fits.select("g", *kept).join(sizes, "g").join(under(langs, "l_"), "l_g")
    own = _shrunk(own, of("l_"), weight("n")).select("l", "r", "n", "l_n", *(f"m{i}" for i in range(_P)), *(F.col(f"w{i}{j}").alias(f"c{i}{j}") for i, j in _PAIRS))
    return written(_factored(own, ridge=False).select("l", "r", "n", "l_n", *(f"m{i}" for i in range(_P)), *(f"v{i}{j}" for i, j in _PAIRS)), "shrunk")


def _quantile(share: float) -> Column:
    """ln of the distance up to which that share of the texts lies."""
    return F.min(F.when(F.col("upto") >= share * F.col("all"), (F.col("bucket") + 0.5) / F.lit(float(_BUCKETS))))


def _cutoffs(base: DataFrame, fits: DataFrame, cutoff: float, tail: float) -> DataFrame:
    """l, scale, limit: how a language's squared distances compare with those of normal data, and the largest one that stays.

    Distances beyond their median are taken to fall like a Weibull tail through the quantiles 0.5 and 0.8, which up to a fifth of outliers can't move far; both
    are drawn towards the corpus', and those towards normal data, as the estimates are.
    """
    dealt = base.join(fits, ["l", "r"]).withColumn("bucket", F.floor(_BUCKETS * F.ln(_distance() + F.lit(1e-6))))
    counts = written(dealt.groupBy("l", "bucket").agg(F.sum("k").alias("n")), "tails")

    def told(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        inside = Window.partitionBy(*keys)
        upto = df.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(inside.orderBy("bucket")), "all": F.sum("n").over(inside)})
        return upto.groupBy(*keys).agg(_quantile(0.5).alias(f"{prefix}mid"), (_quantile(0.8) - _quantile(0.5)).alias(f"{prefix}rise"), F.sum("n").alias(f"{prefix}n"))

    found = told(counts, ["l"], "").withColumn("one", F.lit(1)).join(told(counts.withColumn("one", F.lit(1)), ["one"], "all_"), "one")
    drawn = lambda x, n, to: (F.col(x) * F.col(n) + to * SHRINK) / (F.col(n) + SHRINK)
    found = found.withColumns({"all_mid": drawn("all_mid", "all_n", math.log(_CHI2_MEDIAN)), "all_rise": drawn("all_rise", "all_n", math.log(_CHI2_UPPER / _CHI2_MEDIAN))})
    found = found.withColumns({"mid": drawn("mid", "n", F.col("all_mid")), "rise": drawn("rise", "n", F.col("all_rise"))})
    steep = math.log(math.log(5) / math.log(2)) / F.greatest("rise", F.lit(1e-3))
    limit = F.pow(F.lit(-math.log(tail) / math.log(2)), 1 / steep) * _CHI2_MEDIAN
    return written(found.select("l", (F.exp("mid") / _CHI2_MEDIAN).alias("scale"), F.greatest(limit, F.lit(cutoff)).alias("limit")), "cutoffs")


def quality_report(docs: DataFrame, cutoff: float = CUTOFF, tail: float = TAIL) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and d2, the squared robust distance (null: failed the base rules).

    A text fails the base rules with fewer than 50 words or more than half its words in repeated windows. The others are
    judged against their language and source; null is a value of its own there. The estimate of a source is drawn towards that of its language, and that towards
    the corpus', the more the fewer texts it has, and the corpus' towards wide spreads, so that a handful of documents rejects none. A document goes if its
    distance, in units of normal data, is beyond `cutoff` and beyond what all but the share `tail` of its language would reach.
    Null or empty text has no words and fails; texts of any length are counted whole. Rows are judged one by one, repeated or
    not, and equal texts of a group alike; an empty table gives no rows; other columns are not looked at.
    """
    measured = written(text_statistics(docs), "statistics")
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source"))
    rounded = [F.round(F.expr(s[0]) / F.lit(s[1])) * F.lit(s[1]) for s in STATISTICS]
    texts = measured.where("not base_failed").select("text_hash", lang.alias("l"), source.alias("r"), *(c.alias(x) for c, x in zip(rounded, _X))).distinct()
    base = written(texts.groupBy("l", "r", *_X).agg(F.count("*").alias("k")), "vectors")
    fits = _levels(base)
    fits = written(fits.join(_cutoffs(base, fits, cutoff, tail), "l").drop("n", "l_n"), "fits")
    judged = measured.withColumns({"l": lang, "r": source, **{x: F.expr(f"case when not base_failed then {s[0]} end") for s, x in zip(STATISTICS, _X)}})
    named = fits.withColumnsRenamed({"l": "_l", "r": "_r"})
    if fits.count() <= _BROADCAST_GROUPS:
        judged = judged.join(F.broadcast(named), (F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r")), "left")
    else:
        judged = equi_join(judged, named, ["l", "r"], ["_l", "_r"], "left", unique_right=True)
    judged = judged.withColumn("d2", _distance() / F.col("scale"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= F.coalesce("limit", F.lit(cutoff)))).alias("kept"), "d2")


def passing(docs: DataFrame, cutoff: float = CUTOFF, tail: float = TAIL) -> DataFrame:
    """The rows of `docs` that are kept, all columns kept. A row goes if any row of its doc_id is rejected; one without a
    doc_id stays only if no such row is rejected. Only ids that may be rejected are joined; the other rows are not shuffled."""
    report = quality_report(docs, cutoff, tail).where("not kept").select(F.col("doc_id").cast("long").alias("_gone")).distinct()
    return without(docs, "doc_id", written(report, "rejected"))
