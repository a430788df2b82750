"""The skew-safe plans give the same rows as the plain ones, on data where one key holds a third of the rows."""

import math

import numpy as np
import pytest
from conftest import LARGE, rows
from pyspark.sql import functions as F

from tablekit.operators import aggregate, charts, infer, occurrence as occ, profile, windows as win
from tablekit.operators.dedup import drop_duplicate_rows
from tablekit.operators.filters import Condition as C, apply_filter
from tablekit.operators.joins import join_tables
from tablekit.operators.reshape import list_rows, pivot_table
from tablekit.operators.sample import sample_rows
from tablekit.plans import layout, running
from tablekit.plans.layout import with_row_id
from tablekit.plans.running import exact_quantiles, running_sum
from tablekit.plans.skew import equi_join


def skewed(spark, n=900, seed=7, parts=5):
    """Key 1 holds a third of the rows, null a tenth, the rest spread; ids are unique."""
    i = F.col("id")
    k = F.when(i % 3 == 0, 1).when(i % 10 == 1, F.lit(None)).otherwise(F.pmod(F.hash(i + seed), F.lit(60)))
    return spark.range(0, n, 1, parts).select(
        i, k.cast("int").alias("k"), F.pmod(F.hash(i * seed), F.lit(25)).cast("double").alias("v"),
        F.when(i % 4 == 0, "same").otherwise(F.concat(F.lit("t"), (i % 50).cast("string"))).alias("s"))


def both(spark, make):
    """Result under the default plans and under the forced large plans."""
    plain = rows(make())
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    try:
        return plain, rows(make())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_join_types(spark, how, null_safe):
    left = skewed(spark, 300).select(F.col("id").alias("lid"), F.col("k").alias("lk"))
    right = skewed(spark, 210, 3).where("k is null or k % 2 = 1").select(F.col("id").alias("rid"), F.col("k").alias("rk"))
    plain, large = both(spark, lambda: equi_join(left, right, ["lk"], ["rk"], how, null_safe))
    assert plain == large and plain


@pytest.mark.parametrize("how", ["left", "full"])
def test_join_hot_on_one_side_only(spark, how):
    left = skewed(spark, 300).select(F.col("id").alias("lid"), F.col("k").alias("lk"))
    right = spark.range(0, 40, 1, 2).select(F.col("id").cast("int").alias("rk"), F.lit("x").alias("x"))
    for a, b, ka, kb in ((left, right, "lk", "rk"), (right, left, "rk", "lk")):
        plain, large = both(spark, lambda: equi_join(a, b, [ka], [kb], how))
        assert plain == large


def test_join_of_identical_rows(spark, large):
    """Copies of one row must all survive the salting."""
    left = spark.range(0, 500, 1, 7).select(F.lit(1).alias("a"))
    right = spark.range(0, 3).select(F.lit(1).alias("b"))
    assert equi_join(left, right, ["a"], ["b"]).count() == 1500
    assert equi_join(left, right, ["a"], ["b"], "full").count() == 1500


def test_join_salts_hot_key(spark, large):
    left, right = skewed(spark), skewed(spark, 300, 3).withColumnsRenamed({"k": "k2", "id": "id2", "v": "v2", "s": "s2"})
    plan = equi_join(left, right, ["k"], ["k2"])._jdf.queryExecution().executedPlan().toString()
    assert "_li" in plan and "BroadcastHashJoin" in plan


def test_running_sum_and_ranks(spark):
    df = skewed(spark)
    nulled = df.withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v")))
    for make in (lambda: running_sum(nulled, ["k"], ["id"], "v", "r"), lambda: win.cumulative_sum(df, ["s"], "v", "r", ["k", "id"]),
                 *[lambda m=m, d=d: win.rank_over(nulled, ["k"], "v", "r", d, m).withColumn("r", F.col("r").cast("double"))
                   for m in ("average", "min", "max", "dense") for d in (True, False)]):
        plain, large = both(spark, make)
        assert plain == large


def test_quantiles(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 13 != 0, F.col("v") + F.col("id") % 3))
    points = {"lo": 0.0, "q1": 0.25, "med": 0.5, "p90": 0.9, "hi": 1.0}
    for keys in ([], ["k"], ["k", "s"]):
        plain, large = both(spark, lambda: exact_quantiles(df, keys, "v", points))
        assert len(plain) == len(large)
        for a, b in zip(plain, large):
            assert a == pytest.approx(b) if None not in a else a == b


def test_window_values(spark):
    df = skewed(spark)
    for make in (lambda: win.sum_over(df, ["k"], "v", "t"), lambda: win.first_over(df, ["k"], "s", "f", "id"),
                 lambda: win.aggregate_over(df, ["k", "s"], {"n": F.count("*"), "m": F.max("id")})):
        plain, large = both(spark, make)
        assert plain == large


def test_group_totals_joined_back(spark):
    df = skewed(spark, 400)
    for make in (lambda: win.sum_over(df, ["k"], "v", "t"), lambda: charts.box_outliers(df.withColumn("v", F.col("v") * F.col("v")), "v", "s")):
        plain, large = both(spark, make)
        assert plain == large


@pytest.mark.parametrize("how", ["inner", "left", "full", "left_anti"])
def test_null_keys_are_dealt_out(spark, large, how):
    """Half the keys are null: no partition of the join gets more than a share of them, and the rows are those of a plain join."""
    from tablekit.plans.skew import equi_join
    left = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 9).alias("j"), F.col("id").alias("b"))
    small = right.where("j is null or b < 60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = equi_join(left, small, ["k"], ["j"], how)
        assert rows(out) == rows(left.join(small, left["k"] == small["j"], how))
        if how != "inner":
            nulls = [r["n"] for r in out.where("k is null and a is not null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(nulls) == 1000 and max(nulls) <= 2 * 1000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dotted_names_and_a_threshold_with_a_unit(spark, large):
    from tablekit.operators.aggregate import group_summary
    from tablekit.operators.joins import join_tables
    df = spark.range(300).select((F.col("id") % 3).alias("g.k"), F.col("id").alias("v.x"), F.concat(F.lit("p"), F.col("id") % 2).alias("c.c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        assert join_tables(df, df.withColumnRenamed("v.x", "w.x").limit(6), "g.k").count() == 600
        assert group_summary(df, ["g.k"], "median", "v.x").count() == 3
        assert win.cumulative_sum(df, ["g.k"], "v.x", "run.x", "v.x").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_whole_numbers_stay_exact(spark):
    from tablekit.operators.convert import cast_columns, apply_conversion, INTEGER
    base = 2**53
    df = spark.createDataFrame([(base,), (base + 1,), (2**63 - 1,), (None,), (-2**63,)], "k long")
    test = lambda sign, a, b="": {r.k for r in apply_filter(df, [C("k", sign, a, b, field_type="Numeric")]).collect()}
    assert test("Equals", str(base + 1)) == {base + 1} and test(">", str(base)) == {base + 1, 2**63 - 1} and test("<=", f"{base}.5") == {base, -2**63}
    assert test(">", "1e30") == set() and test("<", "1e30") == {base, base + 1, 2**63 - 1, -2**63} and test("Between", str(base + 1), "-5") == {base, base + 1}
    text = df.select(F.col("k").cast("string").alias("t"), F.col("k").cast("string").alias("u"))
    assert rows(apply_conversion(cast_columns(text, ["t"], "Integer"), "u", INTEGER).where("u != 0")) == rows(df.select("k", F.col("k").alias("u")).where("k is not null"))


def test_occurrence(spark):
    df = skewed(spark)
    for make in (lambda: occ.first_occurrence(df, "k", "id"), lambda: occ.last_occurrence(df, "k", "id"),
                 lambda: occ.any_duplicate(df, "k"), lambda: occ.only_unique(df, "k"),
                 lambda: apply_filter(df, [C("k", occ.FIRST), "or", C("s", occ.DUPLICATE, negate=True), "or",
                                           C("s", occ.UNIQUE), "or", C("k", occ.LAST)], order_by="id")):
        plain, large = both(spark, make)
        assert plain == large


def test_first_occurrence_limits_before_shuffle(spark):
    plan = occ.first_occurrence(skewed(spark), "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2




def test_occurrence_partitions_the_table(spark):
    df = skewed(spark)
    assert occ.any_duplicate(df, "k").count() + occ.only_unique(df, "k").count() == df.count()
    assert occ.first_occurrence(df, "k", "id").count() == df.select("k").distinct().count()


def test_charts_and_profiles(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 90 == 0, 500.0).otherwise(F.col("v")))
    for make in (lambda: charts.box_table(df, "v", "s"), lambda: charts.box_table(df, "v"), lambda: charts.box_outliers(df, "v", "k"),
                 lambda: profile.describe_table(df), lambda: profile.numeric_profile(df, ["v", "k"]),
                 lambda: charts.series_table(df, "s"), lambda: pivot_table(df, "k", "s", "v", "median"),
                 lambda: list_rows(df, "k", "s", "v", "id")):
        plain, large = both(spark, make)
        assert len(plain) == len(large)
        for a, b in zip(plain, large):
            for x, y in zip(a, b):
                assert x == y or x == pytest.approx(y)


@pytest.mark.parametrize("parts", [1, 8])
def test_row_ids(spark, parts):
    df = skewed(spark).repartition(parts)
    for order in (["id"], ["k", "id"], ["s", "v", "id"]):
        got = [r["id"] for r in with_row_id(df, order).orderBy("_row_id").collect()]
        assert got == [r["id"] for r in df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()]
        assert rows(with_row_id(df, order).select("_row_id")) == [(i,) for i in range(900)]
    assert rows(with_row_id(df).select("_row_id")) == [(i,) for i in range(900)]


def test_row_ids_with_equal_keys_and_copies(spark):
    copies = spark.range(0, 300, 1, 6).select(F.lit("x").alias("a"), (F.col("id") % 2).alias("b"))
    numbered = with_row_id(copies, "a")
    assert rows(numbered.select("_row_id")) == [(i,) for i in range(300)]
    assert with_row_id(spark.range(0).select(F.col("id").alias("a"))).count() == 0


def test_dedup_layouts(spark):
    df = skewed(spark).select("id", "k", "s")
    results = {(p, keep): rows(drop_duplicate_rows(df.repartition(p), keep, order_by="id")) for p in (1, 8) for keep in ("first", "last", "none")}
    for keep in ("first", "last", "none"):
        assert results[1, keep] == results[8, keep]
    assert len(results[1, "first"]) == df.select("k", "s").distinct().count()


def test_sample_is_exact_and_independent_of_layout(spark):
    df = skewed(spark)
    first = rows(sample_rows(df.repartition(1), 100, key="id"), "id")
    assert len(first) == 100 and first == rows(sample_rows(df.repartition(8), 100, key="id"), "id")
    assert first != rows(sample_rows(df, 100, seed=1, key="id"), "id")
    assert sample_rows(df, 10_000, key="id").count() == 900


def test_sample_of_any_size_takes_one_path(spark, monkeypatch):
    import tablekit.operators.sample as smp
    df = skewed(spark)
    draws = sorted((r["d"], r["id"]) for r in df.select(F.xxhash64("id", F.lit(42)).alias("d"), "id").collect())
    for room in (100_000, 1):
        monkeypatch.setattr(smp, "_SORTED_ROWS", room)
        for n in (1, 300, 899):
            got = sample_rows(df, n, key="id")
            assert [r["id"] for r in got.orderBy("id").collect()] == sorted(i for _, i in draws[:n])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort" not in plan
    assert sample_rows(df, 0, key="id").count() == 0


def test_sample_by_content(spark, large, monkeypatch):
    """Copies are drawn one by one: a row that makes up half the table makes up about half the sample."""
    import tablekit.operators.sample as smp
    df = spark.range(0, 2000, 1, 5).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("s"), F.lit(None).cast("int").alias("n"))
    got = rows(sample_rows(df, 400))
    assert len(got) == 400 and got == rows(sample_rows(df.repartition(9), 400)) and got != rows(sample_rows(df, 400, seed=3))
    assert 150 <= sum(r[0] == "hot" for r in got) <= 250 and max(sum(r == x for r in got) for x in got if x[0] != "hot") == 1
    monkeypatch.setattr(smp, "_SORTED_ROWS", 5)
    assert rows(sample_rows(df, 400)) == got and sample_rows(df, 5000).count() == 2000


def test_pivot_of_any_width(spark):
    import tablekit.operators.reshape as shapes
    df = spark.createDataFrame([(1, "c", 5.0), (1, "a", 2.0), (1, "a", 3.0), (2, "d", None), (2, None, 9.0), (None, "b", 1.0), (3, "c", 7.0)], "k int, h string, v double")
    want = [(1, 0, "a", 5.0), (1, 2, "c", 5.0), (3, 2, "c", 7.0), (None, 1, "b", 1.0)]
    plain, large = both(spark, lambda: shapes.pivot_long(df, "k", "h", "v", "sum"))
    assert plain == large == want
    arrays = {r["k"]: [tuple(c) for c in r["cells"]] for r in shapes.pivot_arrays(df, "k", "h", "v", "sum").collect()}
    assert arrays == {1: [(0, 5.0), (2, 5.0)], 2: [], 3: [(2, 7.0)], None: [(1, 1.0)]}
    groups = {(r["k"], r["group"]): r["cells"] for r in shapes.pivot_groups(df, "k", "h", "v", "sum", width=2).collect()}
    assert groups == {(1, 0): [5.0, None], (1, 1): [5.0, None], (3, 1): [7.0, None], (None, 0): [None, 1.0]}
    many = spark.range(0, 60_000, 1, 4).select((F.col("id") % 3).alias("k"), (F.col("id") % 50_000).alias("h"), F.lit(1).alias("v"))
    with pytest.raises(ValueError, match="pivot_long"):
        pivot_table(many, "k", "h", "v", "sum")
    packed = shapes.pivot_arrays(many, "k", "h", "v", "count").collect()
    assert sum(len(r["cells"]) for r in packed) == many.select("k", "h").distinct().count() and max(c["rank"] for r in packed for c in r["cells"]) == 49_999


def test_density_curves_are_sums_over_all_values(spark):
    import math
    import random
    rng = random.Random(4)
    values = {"a": [rng.gauss(0, 1) for _ in range(400)] + [250.0], "b": [rng.choice([1.0, 2.0, 5.0]) for _ in range(300)], "one": [3.0], "same": [4.0] * 5}
    df = spark.createDataFrame([(k, v) for k, some in values.items() for v in some], "k string, v double")
    got = {(r["k"], r["point"]): (r["x"], r["density"]) for r in charts.kde_curve(df, "v", ["k"], 200).collect()}
    assert len(got) == 800
    for k in ("a", "b"):
        own = values[k]
        n, mean = len(own), sum(own) / len(own)
        band = math.sqrt(sum((v - mean) ** 2 for v in own) / (n - 1)) * n ** -0.2
        for p in range(200):
            x, density = got[k, p]
            want = sum(math.exp(-((x - v) / band) ** 2 / 2) for v in own) / (n * band * math.sqrt(2 * math.pi))
            assert abs(density - want) < 1e-12 / band
    assert all(got[k, p][1] is None for k in ("one", "same") for p in range(200))


def test_statistics_of_few_groups_do_not_move_the_rows(spark):
    """Two groups of any size are not sorted in two tasks, even where Spark would broadcast nothing by itself."""
    df = spark.range(0, 3000, 1, 4).select((F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))

    def curves():
        return [charts.distribution_kde(df, ["a", "b"], 20), charts.kde_curve(df, "a", ["k"], 20), charts.box_table(df, "a", "k"), charts.box_outliers(df, "a", "k")]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [c._jdf.queryExecution().executedPlan().toString() for c in curves()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    df = df.where("id < 150").coalesce(2)
    for make in (lambda: charts.kde_curve(df, "a", ["k"], 20), lambda: charts.box_outliers(df.withColumn("a", F.col("a") * F.col("a") * F.col("a")), "a", "k")):
        few, many = both(spark, make)
        assert few and len(few) == len(many) and all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9) for a, b in zip(few, many) for x, y in zip(a, b))


def test_histogram_of_many_bins(spark):
    df = skewed(spark)
    out = charts.histogram_table(df, "id", 100_000, color="s")
    assert out.count() == 100_000 * df.select("s").distinct().count()
    sums = out.groupBy("s").agg(F.sum("value").alias("n"))
    assert rows(sums) == rows(df.groupBy("s").agg(F.count("*").cast("double").alias("n")))
    assert charts.histogram_table(df.where("id < 0"), "id", 5).count() == 0


def test_joined_tables_agree(spark):
    left = skewed(spark, 300)
    right = skewed(spark, 200, 5).select("k", F.col("v").alias("w"), "s")
    for how in ("inner", "left", "outer", "semi", "anti"):
        plain, large = both(spark, lambda: join_tables(left, right, "k", how=how))
        assert plain == large


def test_column_quantiles_narrow_to_the_exact_ranks(spark, monkeypatch):
    monkeypatch.setattr(running, "_NARROWING", 10)
    values = [((i * 7919) % 1009) ** 3 / 7.0 for i in range(1000)] + [5.0] * 400 + [-1e300, 1e300, float("nan"), None]
    df = spark.createDataFrame([(v, i % 3 if i % 5 else None, None) for i, v in enumerate(values)], "v double, small int, nothing double")
    points = {"least": 0.0, "low": 0.25, "mid": 0.5, "high": 0.999, "most": 1.0}
    got = running.column_quantiles(df, {c: F.col(c) for c in df.columns}, points, few=3)
    clean = {"v": [v for v in values if v is not None and v == v], "small": [i % 3 for i in range(len(values)) if i % 5]}
    for c, want in clean.items():
        for name, share in points.items():
            assert got[c][name] == pytest.approx(float(np.quantile(np.array(want, float), share)), rel=1e-12), (c, name)
    assert got["nothing"] == dict.fromkeys(points)
    assert running.column_quantiles(df.limit(0), {"v": F.col("v")}, points)["v"] == dict.fromkeys(points)


def test_profiles_of_files_and_of_computed_tables_agree(spark, tmp_path):
    df = skewed(spark).select("id", "k", F.col("v").cast("string").alias("v"), F.when(F.col("id") % 2 == 0, F.col("s")).alias("s"),
                              F.lit(None).cast("string").alias("none"), (F.col("id") % 7).cast("double").alias("d"))
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert layout.columns_apart(stored) and not layout.columns_apart(df.distinct())
    for null in (True, False):
        assert rows(profile.distinct_count(stored, df.columns, with_null=null)) == rows(profile.distinct_count(df.distinct(), df.columns, with_null=null))
    assert rows(infer.suggest_types(stored)) == rows(infer.suggest_types(df.distinct()))
    plan = profile.distinct_count(stored, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_carried_cells_are_fetched_late(spark):
    df = skewed(spark)
    late = lambda **kw: aggregate.group_summary(df, ["k"], carry=["s"], **kw)
    plan = late(func="sum", value="v", order_by="id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    first = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        first.setdefault(r["k"], r["s"])
    for make in (lambda: late(func="sum", value="v", order_by="id"), lambda: late(func="median", value="v", order_by=["id", "v"]), lambda: late(func="count", order_by="id")):
        for got in both(spark, make):
            assert {r[0]: r[2] for r in got} == first and len(got) == len(first)
    tied = df.withColumn("o", F.lit(1))  # rows that share the first key
    assert {r["k"]: r["s"] for r in aggregate.group_summary(tied, ["k"], carry=["s"], order_by=["o", "id"]).collect()} == first
    assert aggregate.group_summary(df.limit(0), ["k"], carry=["s"], order_by="id").count() == 0
