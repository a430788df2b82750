"""Edge tables and worked examples."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from tablekit.functions import parse
from tablekit import functions as fn
from tablekit.operators import columns, combine, convert, filters, infer, occurrence as occ, profile
from tablekit.operators.dedup import drop_duplicate_rows
from tablekit.operators.filters import BadLiteral, Condition as C, apply_filter, compile_filter
from tablekit.operators.joins import join_tables
from tablekit.operators.recipe import Recipe, apply_recipe
from tablekit.operators.reshape import melt_table, pivot_table
from tablekit.operators.sample import column_sample_size, sample_size


@pytest.fixture
def edge(spark):
    data = [(0, None, "1.5", "2024-01-05", 1), (1, "", "abc", "2024-13-45", 1), (2, "A", "10", "2024-02-01", 2), (3, "a", None, None, 2),
            (4, "a|b", "-3", "2023-12-31", 1), (5, "x.*y", "1e2", "2024-01-05", 3), (6, "A", "10", "2024-02-01", 2), (7, None, "5d", "x", 4)]
    return spark.createDataFrame(data, "_row_id bigint, k string, n string, d string, g int")


def ids(df):
    return [r[0] for r in rows(df, "_row_id")]


CONDITIONS = [
    (C("k", "Contains", "A"), [2, 3, 4, 6]), (C("k", "Contains", "A", case_sensitive=True), [2, 6]),
    (C("k", "Contains", ""), [0, 1, 2, 3, 4, 5, 6, 7]), (C("k", "Equals", "a"), [2, 3, 6]), (C("k", "Equals", ""), [0, 1, 7]),
    (C("k", "Equals", "A", case_sensitive=True, negate=True), [0, 1, 3, 4, 5, 7]),
    (C("k", "Empty"), [0, 1, 7]), (C("k", "Contains", ".*"), [5]), (C("k", "Contains", "x.*y", use_regex=True), [5]),
    (C("k", "Equals", "a|b", use_regex=True), [2, 3, 6]), (C("k", ">", "a", use_regex=True), []),
    (C("k", ">", "a", use_regex=True, negate=True), [0, 1, 2, 3, 4, 5, 6, 7]), (C("k", "Contains", "(", use_regex=True), []),
    (C("k", "Between", "b", "A"), [2, 3, 4, 6]), (C("k", "<", "a"), [0, 1, 7]),
    (C("n", ">", "2", field_type="Numeric"), [2, 5, 6]), (C("n", "Between", "20", "1", field_type="Numeric"), [0, 2, 6]),
    (C("n", "Between", "20", "", field_type="Numeric"), []), (C("n", "Equals", "", field_type="Numeric"), [1, 3, 7]),
    (C("n", ">", "", field_type="Numeric"), []), (C("n", "Empty", field_type="Numeric"), [3]),
    (C("n", ">", "2", field_type="Numeric", negate=True), [0, 4]), (C("n", ">", "cheap", field_type="Numeric"), []),
    (C("g", "Equals", "1.5", field_type="Numeric"), []), (C("g", "Equals", "1.5", field_type="Numeric", negate=True), [0, 1, 2, 3, 4, 5, 6, 7]),
    (C("g", ">=", "1.5", field_type="Numeric"), [2, 3, 5, 6, 7]), (C("g", "<", "2.5", field_type="Numeric"), [0, 1, 2, 3, 4, 6]),
    (C("g", "<", "inf", field_type="Numeric"), [0, 1, 2, 3, 4, 5, 6, 7]),
    (C("d", "Equals", "2024-01-05", field_type="Date"), [0, 5]), (C("d", "Contains", "2024-01-05", field_type="Date"), [0, 5]),
    (C("d", "Between", "2024-02-01", "2024-01-01", field_type="Date"), [0, 2, 5, 6]), (C("d", "<", "soon", field_type="Date"), []),
    (C("d", "Equals", "", field_type="Date"), []), (C("d", "Empty", field_type="Date"), [3]), (C("d", ">", "2024-01-05", field_type="Date", negate=True), [0, 4, 5]),
    (C("nope", "Equals", "1"), []),
]


def test_conditions(edge):
    tests = [compile_filter([c], edge.schema).alias(f"t{i}") for i, (c, _) in enumerate(CONDITIONS)]
    got = edge.select("_row_id", *tests).collect()
    for i, (cond, kept) in enumerate(CONDITIONS):
        assert sorted(r["_row_id"] for r in got if r[f"t{i}"]) == kept, cond


@pytest.mark.parametrize("cond, kept", [
    (C("k", occ.FIRST), [0, 1, 2, 3, 4, 5]), (C("k", occ.LAST), [1, 3, 4, 5, 6, 7]), (C("k", occ.DUPLICATE), [0, 2, 6, 7]),
    (C("k", occ.UNIQUE), [1, 3, 4, 5]), (C("k", occ.FIRST, negate=True), [6, 7]), (C("n", "Between", "20", "1", field_type="Numeric"), [0, 2, 6])])
def test_filtered_rows(edge, cond, kept):
    assert ids(apply_filter(edge, [cond])) == kept


def test_fold_and_errors(edge):
    a, b, c = C("g", "Equals", "1", field_type="Numeric"), C("g", "Equals", "2", field_type="Numeric"), C("k", "Equals", "a")
    assert ids(apply_filter(edge, [a, "or", b, "and", c])) == [2, 3, 6]
    assert ids(apply_filter(edge, [a, b])) == []
    assert ids(apply_filter(edge, [])) == list(range(8))
    with pytest.raises(BadLiteral):
        compile_filter([C("n", ">", "cheap", field_type="Numeric")], edge.schema, on_error="raise")
    with pytest.raises(ValueError):
        filters.where_sql(edge, "nothing > 1")


def test_negating_twice(edge):
    once = apply_filter(edge, [C("n", ">", "2", field_type="Numeric")])
    again = apply_filter(edge, [C("n", ">", "2", field_type="Numeric", negate=True)])
    assert once.count() + again.count() == edge.where("try_cast(n as double) is not null and n <> '5d'").count()


def test_scan_pushdown(spark):
    def pushed(table, cond):
        df = apply_filter(spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet"), [cond])
        return df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]

    assert "GreaterThan(o_totalprice,5.0)" in pushed("orders", C("o_totalprice", ">", "5", field_type="Numeric"))
    assert "LessThanOrEqual(l_partkey,10)" in pushed("lineitem", C("l_partkey", "<=", "10.5", field_type="Numeric"))
    assert "GreaterThanOrEqual(o_orderdate" in pushed("orders", C("o_orderdate", "Equals", "1996-01-02", field_type="Date"))
    assert "EqualNullSafe(o_orderstatus,F)" in pushed("orders", C("o_orderstatus", "Equals", "F", case_sensitive=True))


def test_dedup_edges(edge):
    twin = edge.select("_row_id", "k", "n", "d", "g")
    assert ids(drop_duplicate_rows(twin, "first")) == [0, 1, 2, 3, 4, 5, 7]
    assert ids(drop_duplicate_rows(twin, "last")) == [0, 1, 3, 4, 5, 6, 7]
    assert ids(drop_duplicate_rows(twin, "none")) == [0, 1, 3, 4, 5, 7]
    assert ids(drop_duplicate_rows(twin, "first", ["k"])) == [0, 1, 2, 3, 4, 5]
    assert ids(drop_duplicate_rows(twin, "none", ["k"])) == [1, 3, 4, 5]


NUMBERS = [
    ("1234.5", 1234.5), ("1,234.5", 1234.5), ("1.234", 1.234), ("€1.234,50", 1234.5), ("(5)", -5.0), ("(5%)", -0.05), (None, 0.0),
    ("1.234,5", 1234.5), ("1,234", 1234.0), ("12,5", 12.5), ("$7", 7.0), ("45%", 0.45), ("abc", 0.0), ("None", 0.0), ("1,234,567", 1234567.0),
    (" 12 ", 12.0), ("-3,5", -3.5), ("5d", 0.0), ("0x10", 0.0), ("£ 9", 9.0), ("1.234.567,89", 1234567.89)]


def test_number_parser(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(NUMBERS)], "i int, raw string")
    for i, got in rows(df.select("i", parse.number_from_text(F.col("raw")))):
        assert got == pytest.approx(NUMBERS[i][1]), NUMBERS[i]


def test_number_parser_default_can_be_null(spark):
    assert spark.createDataFrame([("abc",)], "raw string").select(parse.number_from_text(F.col("raw"), None)).first()[0] is None


DATES = [
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("31-12-2020", "2020-12-31 00:00:00"),
    ("1-2-2024", "2024-02-01 00:00:00"), ("2024/01/02", "2024-01-02 00:00:00"), ("31/12/2020", "2020-12-31 00:00:00"),
    ("Dec 30, 2020 12:00:00 AM", "2020-12-30 00:00:00"), ("Dec 30, 2020 12:00 AM", "2020-12-30 00:00:00"),
    ("December 30, 2020 12:00:00 AM", "2020-12-30 00:00:00"), ("Dec 30, 2020 12:00:00", "2020-12-30 12:00:00"),
    ("Dec 30, 2020 12:00", "2020-12-30 12:00:00"), ("December 30, 2020 12:00:00", "2020-12-30 12:00:00"), ("30-Dec-20", "2020-12-30 00:00:00"),
    ("30-Dec-99", "1999-12-30 00:00:00"), ("30 Dec 2020", "2020-12-30 00:00:00"), ("01/01/24", "2024-01-01 00:00:00"),
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02 03:04:05.123", "2024-01-02 03:04:05"), ("45000", "2023-03-15 00:00:00"), ("45000.0", "2023-03-15 00:00:00"), ("20240101", None),
    ("45000.5", None), ("None", None), ("", None), ("2024-13-45", None), ("  2024-01-02  ", "2024-01-02 00:00:00"), ("hello", None), (None, None)]


def test_datetime_parser(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(DATES)], "i int, raw string")
    for i, got in rows(df.select("i", parse.datetime_from_text(F.col("raw")))):
        assert got == (DATES[i][1] and dt.datetime.fromisoformat(DATES[i][1])), DATES[i]


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("t",), ("1",), ("No",), ("0",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(parse.boolean_from_text(F.col("v"))).collect()] == [True, True, True, False, False, None, None]
    assert [r[0] for r in df.select(parse.boolean_from_text(F.col("v"), True)).collect()] == [True, True, True, False, False, False, False]


def test_convert_policies(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("2", "x"), ("3", "y")], "a string, d string")
    out, report = convert.convert_columns(df, {"a": convert.INTEGER, "d": convert.DATETIME, "z": convert.FLOAT})
    assert dict(out.dtypes) == {"a": "bigint", "d": "string"}
    assert [r[2] for r in report.orderBy("column").collect()] == ["converted", "skipped", "error"]
    with pytest.raises(convert.HarmfulConversion):
        convert.convert_columns(df, {"d": convert.DATETIME}, policy="raise")
    assert dict(convert.convert_columns(df, {"d": convert.DATETIME}, policy="warn")[0].dtypes)["d"] == "timestamp_ntz"
    flagged = convert.null_growth(df, {"d": convert.DATETIME}, convert.SINGLE_GUARD).first()["flagged"]
    assert flagged is False
    category = convert.apply_conversion(df, "a", convert.CATEGORY)
    assert infer._typed_class(category.withColumn("b", F.lit(1)).schema["a"]) == convert.CATEGORY
    stamped = spark.createDataFrame([(1_000_000,)], "n bigint")
    assert convert.apply_conversion(stamped, "n", convert.DATETIME).first()[0] == dt.datetime(1970, 1, 1, 0, 0, 1)
    assert convert.cast_columns(df, ["d"], "Float").first()["d"] is None


def test_worked_join(spark):
    left = spark.createDataFrame([(1, "2023-01-01", 10), (1, "2023-01-02", 12), (2, "2023-01-01", 20)], "ID bigint, Date string, ValueL bigint")
    right = spark.createDataFrame([(1, "2023-01-01", 100), (2, "2023-01-01", 200), (1, "2023-01-03", 300)],
                                  "UserID bigint, EventDate string, ValueR bigint")
    got = rows(join_tables(left, right, ["ID", "Date"], ["UserID", "EventDate"], "inner"))
    assert got == [(1, "2023-01-01", 10, 100), (2, "2023-01-01", 20, 200)]
    with pytest.raises(ValueError):
        join_tables(left, right, how="inner")


def test_worked_melt_and_pivot(spark):
    wide = spark.createDataFrame([("A", 10, 12)], "Product string, Q1_Sales int, Q2_Sales int")
    long = melt_table(wide, ["Product"], None, "Quarter", "Sales")
    assert rows(long) == [("A", "Q1_Sales", 10), ("A", "Q2_Sales", 12)]
    assert rows(pivot_table(long.withColumn("_row_id", F.lit(0)), "Product", "Quarter", "Sales", "first")) == [("A", 10, 12)]
    with pytest.raises(ValueError):
        pivot_table(long, "Product", "Product", "Sales")


def test_pivot_list_and_count(spark):
    df = spark.createDataFrame([("i", "x", 1, 2), ("i", "x", None, 1), ("j", "y", 5, 0)], "i string, c string, v int, _row_id int")
    assert rows(pivot_table(df, "i", "c", "v", "count")) == [("i", 1, None), ("j", None, 1)]
    assert {r["i"]: r["x"] for r in pivot_table(df, "i", "c", "v", "list").collect()}["i"] == [None, 1]


def test_stacking(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("y", "z")], "id string, extra string")
    with pytest.raises(ValueError):
        combine.stack_strict(a, b)
    assert rows(combine.stack_relaxed(a, b)) == [("1", "x", None), ("y", None, "z")]
    with pytest.raises(ValueError):
        combine.stack_common(a, b.select("extra"))
    types = [(T.IntegerType(), T.LongType(), T.LongType()), (T.IntegerType(), T.FloatType(), T.DoubleType()), (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
             (T.StringType(), T.IntegerType(), T.StringType()), (T.NullType(), T.BooleanType(), T.BooleanType()),
             (T.DecimalType(10, 2), T.LongType(), T.DecimalType(22, 2)), (T.BooleanType(), T.IntegerType(), T.StringType())]
    for x, y, z in types:
        assert combine.common_type(x, y) == combine.common_type(y, x) == z


def test_name_matching():
    got = combine.match_names(["Order ID", "cust_name", "total", "zzz"], ["name cust", "order-id", "totals", "other"])
    assert got == {"Order ID": "order-id", "cust_name": "name cust", "total": "totals", "zzz": None}
    assert combine.match_names(["a1", "a2"], ["a3"], 50) == {"a1": "a3", "a2": None}
    assert combine.match_names(["a1"], [], keep_unmatched=False) == {}


def test_beside_pads(spark):
    a = spark.range(3).select(F.col("id").alias("_row_id"), (F.col("id") * 2).alias("v"))
    b = spark.range(5).select(F.col("id").alias("_row_id"), (F.col("id") * 3).alias("v"))
    assert rows(combine.beside(a, b)) == [(0, 0, 0), (1, 2, 3), (2, 4, 6), (3, None, 9), (4, None, 12)]


def test_header_promotion(spark):
    df = spark.createDataFrame([(0, "junk", None, "j"), (1, "id", "id", ""), (2, "1", "2", "3")], "_row_id bigint, a string, b string, c string")
    out = columns.promote_header(df, 1)
    assert out.columns == ["id", "id_2", "col_2", "_row_id"] and rows(out) == [("1", "2", "3", 0)]
    with pytest.raises(ValueError):
        columns.promote_header(df, 9)


def test_columns(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True, dt.date(2024, 1, 2), 0)], "i int, f double, s string, b boolean, d date, _row_id bigint")
    assert columns.columns_of_type(df, ["numeric"]) == ["i", "f"] and columns.columns_of_type(df, "categorical") == ["s", "b"]
    assert columns.columns_of_type(df) == ["i", "f", "s", "b", "d"] and columns.columns_of_type(df, ["temporal", "float"]) == ["f", "d"]
    assert rows(columns.display_text(df, ["d", "i"])) == [("2024-01-02 00:00:00", "1")]
    with pytest.raises(ValueError):
        columns.drop_columns(df, "zz")
    assert rows(columns.marker_size(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v"), "marker_size") == [(2.0,), (2.0,)]


def test_recipe(spark, tmp_path):
    recipe = Recipe({"a": "id + 1"}).record("b", "a * 2").record("a", "id + 10")
    assert list(recipe.steps) == ["b", "a"]
    again = Recipe({"a": "id + 1"}).record("b", "a * 2").forget("zz")
    again.save(str(tmp_path / "r.json"))
    assert rows(apply_recipe(spark.range(2), Recipe.load(str(tmp_path / "r.json")))) == [(0, 1, 2), (1, 2, 4)]


def test_suggestions(spark):
    df = spark.createDataFrame([("yes", "1", None), ("No", "0", None)], "a string, b string, c string")
    got = dict((r[0], r[2]) for r in infer.suggest_types(df).collect())
    assert got == {"a": "Boolean", "b": "Number (Integer64)", "c": "String (ID Field/Key)"}
    assert dict((r[0], r[2]) for r in infer.suggest_types(df, wide_booleans=True).collect())["b"] == "Boolean"


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "v double, s string")
    assert profile.fill_profile(empty).count() == 2 and profile.describe_table(empty).count() == 9
    assert profile.numeric_profile(empty, ["v"]).first()["count"] == 0


def test_sample_sizes(spark):
    assert sample_size(100_000, False, 100_000, None, None, None) == 383
    assert sample_size(100, True, 0, None, None, None) == 100 and sample_size(50_000, True, 9, 0.0, 3.0, 0.0) == 50_000
    sizes = [sample_size(10**6, True, 10**6, 10.0, 20.0, 60.0, 5, c) for c in (90, 95, 99)]
    assert sizes == sorted(sizes)
    assert column_sample_size(spark.range(50), "zz") == 50


def test_text_helpers(spark):
    df = spark.createDataFrame([("a.b.c", "-5", None)], "s string, n string, z string")
    got = df.select(
        fn.replace_first(F.col("s"), ".", "-", literal=True), fn.replace_first(F.col("s"), "[bc]", "<$0>"), fn.replace_first(F.col("s"), "q", "x"),
        fn.split_exact("s", ".", 3), fn.zfill("n", 4), fn.zfill("n", 1), fn.pad_start("s", 3), fn.pad_start("n", 4, "*"), fn.concat_str("s", "z", separator="+"),
        fn.format_text("{}!{}", "s", "z"), fn.extract("s", "(q)"), fn.slice_text("s", -2), fn.slice_text("s", -9, 6), fn.slice_text("s", 9)).first()
    assert list(got) == ["a-b.c", "a.<b>.c", "a.b.c", ("a", "b", "c", None), "-005", "-5", "a.b.c", "**-5", None, None, None, ".c", "a.", ""]


def test_time_helpers(spark):
    df = spark.sql("select timestamp_ntz'2024-01-31 10:44:59.123456' t")
    t = F.col("t")
    got = df.select(fn.offset_by(t, "1mo"), fn.offset_by(t, "-1y2d"), fn.truncate(t, "1q"), fn.truncate(t, "1w"), fn.truncate(t, "10s"), fn.round_to(t, "1mo"),
                    fn.date_part_ns(t), fn.strftime(t, "%d/%m/%y at %H h"), fn.combine(t, F.lit("01:02:03"))).first()
    stamp = dt.datetime
    assert list(got) == [stamp(2024, 2, 29, 10, 44, 59, 123456), stamp(2023, 1, 29, 10, 44, 59, 123456), stamp(2024, 1, 1), stamp(2024, 1, 29), stamp(2024, 1, 31, 10, 44, 50),
                         stamp(2024, 2, 1), 123456000, "31/01/24 at 10 h", stamp(2024, 1, 31, 1, 2, 3)]
    with pytest.raises(ValueError):
        fn.truncate(t, "soon")


def test_list_helpers(spark):
    df = spark.createDataFrame([([3, 1, 3],)], "a array<int>")
    a = F.col("a")
    got = df.select(fn.list_get(a, 5), fn.list_get(a, -1), fn.last_n(a, 5), fn.first_n(a, 2), fn.sorted_values(a), fn.value_counts_map(a)).first()
    assert list(got) == [None, 3, [3, 1, 3], [3, 1], [1, 3, 3], [(3, 2), (1, 1)]]


def test_value_counts_of_odd_arrays(spark):
    nan = float("nan")
    df = spark.createDataFrame([([2.0, None, nan, 2.0, None, nan, 1.0],), ([],), (None,), ([None],), ([float(i % 7) for i in range(5000)],)], "a array<double>")
    got = [r.v for r in df.select(fn.value_counts_map(F.col("a")).alias("v")).collect()]
    assert [(None if x.value is None else str(x.value), x["count"]) for x in got[0]] == [("2.0", 2), (None, 2), ("nan", 2), ("1.0", 1)]
    assert got[1] == [] and got[2] is None and [tuple(x) for x in got[3]] == [(None, 1)]
    assert [tuple(x) for x in got[4]] == [(float(i), 715 if i < 2 else 714) for i in range(7)]


def test_value_counts_are_worked_out_once(spark, tmp_path):
    """No test of the counts is pushed below them, where it would count again; no comparison of the sorts is an expression of its own."""
    from tablekit.queries import QUERIES

    words = ["b"] * 21 + ["a", "a", "", "\u00e9"] + ["c"] * 25 + ["a"]
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["fn_list_counts"](spark, str(tmp_path))
    assert rows(out) == [(1, 5, 25, 51, 2, "b=21 c=25"), (3, 1, 1, 1, 1, None), (4, 1, 1, 1, 1, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    counted = spark.createDataFrame([(["y", "x", None, "y"],)], "a array<string>").select(fn.value_counts_map(F.col("a")).alias("v"))
    assert "array_sort" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(x) for x in counted.first().v] == [("y", 2), ("x", 1), (None, 1)]
