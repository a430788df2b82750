"""Structured and free-form filters, occurrence filters, de-duplication."""

from pyspark.sql import functions as F

from ..operators.dedup import drop_duplicate_rows
from ..operators.filters import Condition as C, apply_filter, where_sql
from ..operators.occurrence import DUPLICATE, FIRST, LAST, UNIQUE
from .base import query


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def flt_string_contains(t):
    return apply_filter(t.part.select("p_partkey", "p_name"), [C("p_name", "Contains", "RED")])


@query("SELECT o_orderkey + 9007199254740992 AS k FROM orders WHERE o_orderkey + 9007199254740992 > 9007199254741501")
def flt_bigint_exact(t):
    src = t.orders.select((F.col("o_orderkey").cast("long") + F.lit(2**53)).alias("k"))
    return apply_filter(src, [C("k", ">", "9007199254741501", field_type="Numeric")])


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'ECO')")
def flt_string_contains_cs(t):
    return apply_filter(t.part.select("p_partkey", "p_type"), [C("p_type", "Contains", "ECO", case_sensitive=True)])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderstatus) = 'f'")
def flt_string_equals_ci(t):
    return apply_filter(t.orders.select("o_orderkey", "o_orderstatus"), [C("o_orderstatus", "Equals", "f")])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def flt_string_equals_cs(t):
    return apply_filter(t.orders.select("o_orderkey", "o_orderstatus"),
                        [C("o_orderstatus", "Equals", "F", case_sensitive=True)])


@query("SELECT p_partkey, p_brand, p_type FROM part "
       "WHERE lower(p_brand) > 'brand#2' AND lower(p_type) <= 'promo'")
def flt_string_order(t):
    return apply_filter(t.part.select("p_partkey", "p_brand", "p_type"),
                        [C("p_brand", ">", "Brand#2"), "and", C("p_type", "<=", "PROMO")])


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) BETWEEN 'green' AND 'red'")
def flt_string_between(t):
    return apply_filter(t.part.select("p_partkey", "p_name"), [C("p_name", "Between", "Red", "Green")])


@query(r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)\be[rs]th[a-z]+\b.*\d', 's')")
def flt_regex_contains(t):
    return apply_filter(t.documents, [C("text", "Contains", r"(?s)\be[rs]th[a-z]+\b.*\d", use_regex=True)]) \
        .select("doc_id", "lang")


@query(r"SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(lower(p_brand), 'brand#1\d|brand#2')")
def flt_regex_equals(t):
    return apply_filter(t.part.select("p_partkey", "p_brand"), [C("p_brand", "Equals", r"brand#1\d|brand#2", use_regex=True)])


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR FALSE")
def flt_regex_without_order(t):
    return apply_filter(t.part, [C("p_size", "<", "5", field_type="Numeric"), "or",
                                 C("p_name", ">", "a", use_regex=True)]).select("p_partkey")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45.0 AND l_partkey <= 1000.5")
def flt_numeric_cmp(t):
    return apply_filter(t.lineitem, [C("l_quantity", ">", "45", field_type="Numeric"), "and",
                                     C("l_partkey", "<=", "1000.5", field_type="Numeric")]) \
        .select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_tax = 0.02")
def flt_numeric_between(t):
    return apply_filter(t.lineitem, [C("l_discount", "Between", "0.07", "0.05", field_type="Numeric"), "and",
                                     C("l_tax", "Equals", "0.02", field_type="Numeric")]).select("l_orderkey", "l_discount")


def _dirty_orders(t):
    """Order key with customer number as text, some cells unreadable and some null."""
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, "n/a").when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select(key, text.alias("code"))


_DIRTY = ("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN NULL "
          "ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders")


@query(f"SELECT * FROM ({_DIRTY}) WHERE TRY_CAST(code AS DOUBLE) >= 500")
def flt_numeric_text(t):
    return apply_filter(_dirty_orders(t), [C("code", ">=", "500", field_type="Numeric")])


@query(f"SELECT * FROM ({_DIRTY}) WHERE TRY_CAST(code AS DOUBLE) IS NULL")
def flt_numeric_equals_blank(t):
    return apply_filter(_dirty_orders(t), [C("code", "Equals", "", field_type="Numeric")])


@query(f"SELECT * FROM ({_DIRTY}) WHERE code IS NULL")
def flt_empty_numeric(t):
    return apply_filter(_dirty_orders(t), [C("code", "Empty", field_type="Numeric")])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE nullif(o_orderpriority, "
       "'5-LOW') END AS p FROM orders) WHERE p IS NULL OR p = ''")
def flt_empty_string(t):
    p = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return apply_filter(t.orders.select("o_orderkey", p.alias("p")), [C("p", "Empty")]).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderdate, TIMESTAMP '1997-05-28') AS d FROM orders) WHERE d IS NULL")
def flt_empty_date(t):
    d = F.nullif(F.col("o_orderdate"), F.expr("timestamp_ntz'1997-05-28'"))
    return apply_filter(t.orders.select("o_orderkey", d.alias("d")), [C("d", "Empty", field_type="Date")]).select("o_orderkey")


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03' OR CAST(ts AS DATE) > DATE '2024-01-20'")
def flt_date_cmp(t):
    return apply_filter(t.events, [C("ts", "Equals", "2024-01-03", field_type="Date"), "or",
                                   C("ts", ">", "2024-01-20", field_type="Date")]).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def flt_date_between(t):
    return apply_filter(t.orders, [C("o_orderdate", "Between", "1996-12-31", "1996-01-01", field_type="Date")]).select("o_orderkey")


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE "
       "strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) "
       "WHERE TRY_CAST(d AS DATE) <= DATE '1995-06-17'")
def flt_date_text(t):
    d = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return apply_filter(t.orders.select("o_orderkey", d.alias("d")), [C("d", "<=", "1995-06-17", field_type="Date")])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_custkey, 899) AS k, nullif(o_orderstatus, 'P') AS s FROM orders) "
       "WHERE NOT (k > 500) AND NOT (coalesce(s, '') = 'F')")
def flt_not_null_logic(t):
    src = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(899)).alias("k"),
                          F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    return apply_filter(src, [C("k", ">", "500", field_type="Numeric", negate=True), "and",
                              C("s", "Equals", "F", case_sensitive=True, negate=True)]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
       "WHERE ((l_returnflag = 'A' OR l_quantity < 3) AND l_linenumber > 2) OR l_tax = 0.08")
def flt_and_or_fold(t):
    return apply_filter(t.lineitem, [
        C("l_returnflag", "Equals", "A", case_sensitive=True), "or", C("l_quantity", "<", "3", field_type="Numeric"), "and",
        C("l_linenumber", ">", "2", field_type="Numeric"), "or", C("l_tax", "Equals", "0.08", field_type="Numeric"),
    ]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def flt_bad_literal(t):
    return apply_filter(t.orders, [C("o_totalprice", ">", "cheap", field_type="Numeric"), "or",
                                   C("o_orderdate", "Equals", "2024-13-45", field_type="Date"), "or",
                                   C("o_orderstatus", "Equals", "O", case_sensitive=True)]).select("o_orderkey")


@query("SELECT c_custkey FROM customer")
def flt_no_condition(t):
    return apply_filter(t.customer.select("c_custkey"), [])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000 AND year(l_shipdate) = 1998")
def flt_expr(t):
    return where_sql(t.lineitem, "l_extendedprice * (1 - l_discount) > 90000 and year(l_shipdate) = 1998") \
        .select("l_orderkey", "l_partkey")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def flt_first_occurrence(t):
    return apply_filter(t.events.select("event_id", "user_id", "event_type"), [C("user_id", FIRST)], order_by="event_id")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def flt_last_occurrence(t):
    return apply_filter(t.orders.select("o_orderkey", "o_custkey"), [C("o_custkey", LAST)], order_by="o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY count(*) OVER (PARTITION BY o_totalprice) > 1")
def flt_any_duplicate(t):
    return apply_filter(t.orders.select("o_orderkey", "o_totalprice"), [C("o_totalprice", DUPLICATE)])


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1")
def flt_only_unique(t):
    return apply_filter(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), [C("l_orderkey", UNIQUE)])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders "
       "QUALIFY (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AND o_orderstatus = 'F') "
       "OR NOT (count(*) OVER (PARTITION BY o_custkey) > 1)")
def flt_occurrence_mixed(t):
    return apply_filter(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"),
                        [C("o_custkey", FIRST), "and", C("o_orderstatus", "Equals", "F", case_sensitive=True), "or",
                         C("o_custkey", DUPLICATE, negate=True)], order_by="o_orderkey")


def _repeats(t):
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 400).alias("bucket"), "o_orderstatus", "o_orderpriority")


_REPEATS = "SELECT o_orderkey, o_custkey % 400 AS bucket, o_orderstatus, o_orderpriority FROM orders"


@query(f"SELECT min(o_orderkey) AS o_orderkey, bucket, o_orderstatus, o_orderpriority FROM ({_REPEATS}) GROUP BY ALL")
def dedup_first(t):
    return drop_duplicate_rows(_repeats(t), "first", order_by="o_orderkey")


@query(f"SELECT max(o_orderkey) AS o_orderkey, bucket, o_orderstatus, o_orderpriority FROM ({_REPEATS}) GROUP BY ALL")
def dedup_last(t):
    return drop_duplicate_rows(_repeats(t), "last", order_by="o_orderkey")


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def dedup_none(t):
    return drop_duplicate_rows(t.lineitem.select("l_partkey", "l_suppkey", "l_quantity"), "none")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders "
       "QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1")
def dedup_subset(t):
    kept = drop_duplicate_rows(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), "first",
                               ["o_custkey", "o_orderpriority"], order_by="o_orderkey")
    return kept.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
