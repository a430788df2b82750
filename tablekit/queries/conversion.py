"""Type conversion and type suggestion; dirty text is built from whole numbers so that both engines spell it alike."""

from pyspark.sql import functions as F

from ..functions.parse import boolean_from_text, datetime_from_text, excel_serial, number_from_text
from ..operators import convert as conv, infer
from .base import query, text_of

def _key():
    return F.col("o_orderkey")


def _num():
    return F.col("o_custkey")




def _choose(pairs, default):
    """CASE over the remainder of the order key."""
    out = None
    for rest, value in pairs:
        test = _key() % 8 == rest
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


_LOCALE_SQL = ("CASE o_orderkey % 8 WHEN 0 THEN '1.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ',50' "
               "WHEN 1 THEN '2,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.25' "
               "WHEN 2 THEN '3,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') "
               "WHEN 3 THEN '€' || CAST(o_custkey AS VARCHAR) || ',5' WHEN 4 THEN ' $ ' || CAST(o_custkey AS VARCHAR) "
               "WHEN 5 THEN 'abc' WHEN 6 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END")
_LOCALE_VALUE = ("CASE o_orderkey % 8 WHEN 0 THEN 1000.5 + o_custkey % 1000 WHEN 1 THEN 2000.25 + o_custkey % 1000 "
                 "WHEN 2 THEN 3000 + o_custkey % 1000 WHEN 3 THEN o_custkey + 0.5 WHEN 4 THEN o_custkey WHEN 5 THEN 0 WHEN 6 THEN 0 "
                 "ELSE o_custkey END")


def _locale_text():
    three = F.lpad((_num() % 1000).cast("string"), 3, "0")
    whole = _num().cast("string")
    return _choose([(0, F.concat(F.lit("1."), three, F.lit(",50"))), (1, F.concat(F.lit("2,"), three, F.lit(".25"))),
                    (2, F.concat(F.lit("3,"), three)), (3, F.concat(F.lit("€"), whole, F.lit(",5"))),
                    (4, F.concat(F.lit(" $ "), whole)), (5, F.lit("abc")), (6, F.lit(None))], whole)


@query(f"SELECT o_orderkey, {_LOCALE_SQL} AS raw, CAST({_LOCALE_VALUE} AS DOUBLE) AS number FROM orders")
def conv_number_locale(t):
    src = t.orders.select("o_orderkey", _locale_text().alias("raw"))
    return src.withColumn("number", number_from_text(F.col("raw")))


@query("SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN -o_custkey WHEN 1 THEN o_custkey / 100.0 ELSE -o_custkey / 100.0 END, 6) "
       "AS number FROM orders")
def conv_number_percent_paren(t):
    whole = _num().cast("string")
    raw = (F.when(_key() % 3 == 0, F.concat(F.lit("("), whole, F.lit(")"))).when(_key() % 3 == 1, F.concat(whole, F.lit("%")))
           .otherwise(F.concat(F.lit("("), whole, F.lit("%)"))))
    src = t.orders.select("o_orderkey", raw.alias("raw"))
    number = number_from_text(F.col("raw"))
    return src.select("o_orderkey", F.round(F.when(number == 0, 0.0).otherwise(number), 6).alias("number"))


@query(f"SELECT o_orderkey, CAST(trunc(CAST({_LOCALE_VALUE} AS DOUBLE)) AS BIGINT) AS raw FROM orders")
def conv_int(t):
    return conv.apply_conversion(t.orders.select("o_orderkey", _locale_text().alias("raw")), "raw", conv.INTEGER)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN CAST(o_custkey AS DOUBLE) END AS raw FROM orders")
def conv_numeric_lenient(t):
    src = t.orders.select("o_orderkey", _locale_text().alias("raw"))
    return conv.cast_columns(src, ["raw"], "Float")


_LARGE = "(o_orderkey + 9007199254740992)"


@query(f"SELECT o_orderkey, CAST({_LARGE} AS BIGINT) AS raw, CAST({_LARGE} AS BIGINT) AS other FROM orders")
def conv_int_exact(t):
    large = (_key().cast("long") + F.lit(2**53)).cast("string")
    return conv.cast_columns(conv.apply_conversion(t.orders.select("o_orderkey", large.alias("raw"), large.alias("other")), "raw", conv.INTEGER), ["other"], "Integer")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, make_timestamp(o_orderkey * 1000000) AS micros FROM orders")
def conv_datetime_typed(t):
    src = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (_key().cast("long") * 1_000_000).alias("micros"))
    return conv.apply_conversion(conv.apply_conversion(src, "day", conv.DATETIME), "micros", conv.DATETIME)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def conv_text_key(t):
    return conv.apply_conversion(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", conv.TEXT)


@query("SELECT o_orderkey, make_timestamp(2020 + o_orderkey % 5, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, 30, 15.0) AS made, "
       "make_date(2020, 1 + o_orderkey % 12, 3) AS day FROM orders")
def fn_datetime_constructors(t):
    made = F.expr("make_timestamp_ntz(cast(2020 + o_orderkey % 5 as int), cast(1 + o_orderkey % 12 as int), cast(1 + o_orderkey % 28 as int), cast(o_orderkey % 24 as int), 30, 15)")
    return t.orders.select("o_orderkey", made.alias("made"), F.expr("make_date(2020, cast(1 + o_orderkey % 12 as int), 3)").alias("day"))


def _date_text():
    d = F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    return (F.when(_key() % 12 == 0, f("yyyy-MM-dd HH:mm:ss")).when(_key() % 12 == 1, f("yyyy-MM-dd")).when(_key() % 12 == 2, f("dd-MM-yyyy"))
            .when(_key() % 12 == 3, f("yyyy/MM/dd")).when(_key() % 12 == 4, f("d/M/yyyy")).when(_key() % 12 == 5, f("MMM dd, yyyy hh:mm:ss a"))
            .when(_key() % 12 == 6, f("MMMM dd, yyyy HH:mm:ss")).when(_key() % 12 == 7, f("dd MMM yyyy"))
            .when(_key() % 12 == 8, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123Z")))
            .when(_key() % 12 == 9, F.concat(F.lit("  "), f("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00 "))).when(_key() % 12 == 10, "None")
            .otherwise("2024-13-45"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 10 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders")
def conv_datetime_cascade(t):
    src = t.orders.select("o_orderkey", _date_text().alias("raw"))
    return src.select("o_orderkey", text_of(datetime_from_text(F.col("raw"))).alias("parsed"))


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(30000 + o_custkey AS INTEGER), '%Y-%m-%d') AS day FROM orders")
def conv_excel_serial(t):
    src = t.orders.select("o_orderkey", (F.lit(30000) + _num()).cast("string").alias("raw"))
    return src.select("o_orderkey", F.date_format(excel_serial(F.col("raw")), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, '20' || strftime(o_orderdate, '%y-%m-%d') AS day FROM orders")
def conv_short_year(t):
    src = t.orders.select("o_orderkey", F.date_format("o_orderdate", "d/M/yy").alias("raw"))
    return src.select("o_orderkey", F.date_format(datetime_from_text(F.col("raw")), "yyyy-MM-dd").alias("day"))


_FLAG_SQL = ("CASE o_orderkey % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'Yes' WHEN 2 THEN '1' WHEN 3 THEN 'f' WHEN 4 THEN 'No' WHEN 5 THEN '0' "
             "WHEN 6 THEN 'maybe' ELSE NULL END")


def _flags(t):
    return t.orders.select("o_orderkey", _choose([(0, "TRUE"), (1, "Yes"), (2, "1"), (3, "f"), (4, "No"), (5, "0"), (6, "maybe")],
                                                 F.lit(None)).alias("raw"))


@query(f"SELECT o_orderkey, CASE WHEN lower(raw) IN ('true','yes','1','t') THEN TRUE WHEN lower(raw) IN ('false','no','0','f') THEN FALSE "
       f"END AS flag FROM (SELECT o_orderkey, {_FLAG_SQL} AS raw FROM orders)")
def conv_bool(t):
    return _flags(t).select("o_orderkey", boolean_from_text(F.col("raw")).alias("flag"))


@query(f"SELECT o_orderkey, coalesce(lower(raw) IN ('true','yes','1','t'), FALSE) AS flag FROM (SELECT o_orderkey, {_FLAG_SQL} AS raw FROM orders)")
def conv_bool_two_valued(t):
    return _flags(t).select("o_orderkey", boolean_from_text(F.col("raw"), unknown_is_false=True).alias("flag"))


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def conv_category_codes(t):
    return conv.category_codes(t.part.select("p_partkey", "p_brand"), "p_brand", "code")


@query("WITH s AS (SELECT CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS few, "
       "CASE WHEN o_orderkey % 20 = 0 THEN 'soon' ELSE '2024-01-02' END AS day, 'maybe' AS flag FROM orders) "
       "SELECT 'few' AS \"column\", 'Number (Integer64)' AS target, count(*) AS rows, CAST(0 AS BIGINT) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, "
       "FALSE AS flagged FROM s UNION ALL SELECT 'day', 'Datetime', count(*), 0, count(*) FILTER (day = 'soon'), "
       "count(*) FILTER (day = 'soon') > 0.1 * count(*) OR count(*) FILTER (day = 'soon') > 0.05 * count(*) FROM s "
       "UNION ALL SELECT 'flag', 'Boolean', count(*), 0, count(*), FALSE FROM s")
def conv_guard_report(t):
    src = t.orders.select(F.when(_key() % 8 == 0, "x").otherwise(_num().cast("string")).alias("few"),
                          F.when(_key() % 20 == 0, "soon").otherwise("2024-01-02").alias("day"), F.lit("maybe").alias("flag"))
    return conv.null_growth(src, {"few": conv.INTEGER, "day": conv.DATETIME, "flag": conv.BOOLEAN})


@query("WITH s AS (SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS third, count(*) FILTER (o_orderkey % 20 = 0) AS rare, "
       "count(*) FILTER (o_orderkey % 4 = 0) AS often FROM orders) "
       "SELECT 'few' AS \"column\", 'Number (Integer64)' AS target, rows, CAST(0 AS BIGINT) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, FALSE AS flagged FROM s "
       "UNION ALL SELECT 'day', 'Datetime', rows, third, rows, FALSE FROM s UNION ALL SELECT 'rare', 'Boolean', rows, 0, rare, rare > 0.1 * rows FROM s "
       "UNION ALL SELECT 'often', 'Boolean', rows, 0, often, often > 0.1 * rows FROM s")
def conv_guard_single(t):
    """Each column by the guard for one column: more than a tenth of the rows lost; dates are exempt, numbers never become null."""
    word = lambda n: F.when(_key() % n == 0, "maybe").otherwise("yes")
    src = t.orders.select(F.when(_key() % 8 == 0, "x").otherwise("7").alias("few"), F.when(_key() % 3 != 0, "soon").alias("day"), word(20).alias("rare"), word(4).alias("often"))
    return conv.null_growth(src, {"few": conv.INTEGER, "day": conv.DATETIME, "rare": conv.BOOLEAN, "often": conv.BOOLEAN}, conv.SINGLE_GUARD)


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS num, strftime(o_orderdate, '%Y-%m-%d') AS day, "
       "CASE WHEN o_orderkey % 2 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS broken FROM orders")
def conv_batch_skip(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    src = t.orders.select("o_orderkey", _num().cast("string").alias("num"), day.alias("day"),
                          F.when(_key() % 2 == 0, "soon").otherwise(day).alias("broken"))
    out, _ = conv.convert_columns(src, {"num": conv.FLOAT, "day": conv.DATETIME, "broken": conv.DATETIME})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _mixed_text(t):
    return t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(_key() % 2 == 0, "Yes").otherwise("no").alias("flag"), _key().cast("string").alias("whole"),
        F.concat(_num().cast("string"), F.lit(".5")).alias("half"), F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("K"), _key().cast("string")).alias("key"), F.lit(None).cast("string").alias("nothing"), F.col("o_totalprice").alias("typed"),
        F.when(_key() % 40 == 0, "n/a").otherwise(_num().cast("string")).alias("mostly"),
        F.when(_key() % 2 == 0, "1").otherwise("f").alias("short_flag"))


# The rules in SQL, each suggestion decided from the data of one column.
_RULES = """
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS "day", CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag,
  CAST(o_orderkey AS VARCHAR) AS whole, CAST(o_custkey AS VARCHAR) || '.5' AS half, o_orderpriority AS category,
  'K' || CAST(o_orderkey AS VARCHAR) AS "key", CAST(NULL AS VARCHAR) AS nothing,
  CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mostly,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'f' END AS short_flag FROM orders),
cells AS (SELECT * FROM s UNPIVOT INCLUDE NULLS (v FOR "column" IN ("day", flag, whole, half, category, "key", nothing, mostly, short_flag))),
facts AS (SELECT "column", count(v) AS n, count(*) FILTER (v IS NOT NULL AND NOT regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$')) AS bad_date,
  count(*) FILTER (lower(v) NOT IN ('true', 'yes', 'false', 'no'{words})) AS bad_bool,
  count(*) FILTER (v IS NOT NULL AND NOT regexp_matches(v, '^[+-]?\\d+$')) AS bad_int,
  count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS bad_number,
  count(*) FILTER (TRY_CAST(v AS DOUBLE) % 1 <> 0) AS broken, count(DISTINCT v) AS d FROM cells GROUP BY 1)
SELECT "column", 'string' AS current_type, CASE WHEN n = 0 THEN 'String (ID Field/Key)' WHEN bad_date <= 0.05 * n THEN 'Datetime'
  WHEN bad_bool = 0 THEN 'Boolean' WHEN bad_int = 0 THEN 'Number (Integer64)'
  WHEN bad_number <= 0.05 * n THEN CASE WHEN broken > 0 THEN 'Number (Float64)' ELSE 'Number (Integer64)' END
  WHEN d <= 50 OR d <= 0.1 * n THEN 'Categorical' ELSE 'String (ID Field/Key)' END AS suggestion FROM facts
UNION ALL SELECT 'typed', 'double', 'Number (Float64)' FROM (SELECT count(*) FROM orders)"""


@query(_RULES.replace("{words}", ""))
def infer_types(t):
    return infer.suggest_types(_mixed_text(t))


@query(_RULES.replace("{words}", ", '1', 't', '0', 'f'"))
def infer_types_wide(t):
    return infer.suggest_types(_mixed_text(t), wide_booleans=True)


@query("SELECT o_orderkey AS whole, o_orderkey % 2 = 0 AS flag, o_custkey + 0.5::DOUBLE AS half FROM orders")
def infer_apply(t):
    src = _mixed_text(t).select("whole", "flag", "half")
    accepted = {r["column"]: r["suggestion"] for r in infer.suggest_types(src).collect()}
    out, _ = infer.apply_suggestions(src, accepted)
    return out
