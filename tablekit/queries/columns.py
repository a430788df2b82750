"""Columns, sorting, row numbers, recipes."""

from pyspark.sql import functions as F

from ..operators import columns as ops
from ..operators.recipe import Recipe, apply_recipe
from ..operators.sort import sort_by, top_k
from ..plans.layout import with_row_id
from .base import query, rounded, text_of


@query("SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS order_year, "
       "round(o_totalprice / 1000, 6) AS thousands FROM orders")
def col_create(t):
    df = ops.create_column(t.orders, "order_year", "year(o_orderdate)")
    df = ops.create_column(df, "thousands", F.round(F.col("o_totalprice") / 1000, 6))
    return df.select("o_orderkey", "o_orderstatus", "order_year", "thousands")


@query("SELECT c_custkey, upper(c_mktsegment) || '!' AS c_mktsegment FROM customer")
def col_overwrite(t):
    return ops.create_column(t.customer, "c_mktsegment", "concat(upper(c_mktsegment), '!')").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def col_drop(t):
    return ops.drop_columns(t.part, "p_name", "p_type")


@query("SELECT s_suppkey AS supplier, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def col_rename(t):
    return ops.rename_columns(t.supplier, {"s_suppkey": "supplier", "s_name": "name"})


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem")
def col_by_type(t):
    out = ops.select_by_type(t.lineitem, ["integer", "temporal"])
    return out.withColumn("l_shipdate", text_of(F.col("l_shipdate")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders "
       "QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 1001 AND 1500")
def row_page(t):
    return ops.row_page(with_row_id(t.orders.select("o_orderkey"), "o_orderkey"), 2)


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 25")
def row_tail(t):
    numbered = with_row_id(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return ops.tail(numbered, 25).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice, p_partkey) BETWEEN 11 AND 40")
def row_slice(t):
    numbered = with_row_id(t.part.select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"])
    return ops.row_slice(numbered, 10, 30).select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY price NULLS FIRST, o_orderkey) - 1 AS _row_id "
       "FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)")
def sort_asc_nulls(t):
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price")
    src = t.orders.select(F.col("o_orderkey").alias("_row_id"), F.col("o_orderkey"), price)
    return with_row_id(sort_by(src, "price")).select("o_orderkey", "_row_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY price DESC NULLS FIRST, o_orderkey) - 1 AS _row_id "
       "FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)")
def sort_desc_nulls(t):
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price")
    src = t.orders.select(F.col("o_orderkey").alias("_row_id"), F.col("o_orderkey"), price)
    return with_row_id(sort_by(src, "price", ascending=False)).select("o_orderkey", "_row_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS _row_id FROM events")
def row_id_ordered(t):
    return with_row_id(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "_row_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top_k(t):
    return top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"10\", c_name AS \"Customer#000000010\", row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id "
       "FROM customer WHERE c_custkey > 10")
def reheader(t):
    src = t.customer.select(F.col("c_custkey").cast("string"), "c_name")
    return ops.promote_header(with_row_id(src, F.col("c_custkey").cast("bigint")), 10)


@query("SELECT event_id, coalesce(strftime(CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END, '%Y-%m-%d %H:%M:%S'), 'N/A') AS ts, "
       "coalesce(nullif(event_type, 'error'), 'N/A') AS event_type FROM events")
def col_display_text(t):
    src = t.events.select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("ts"),
                          F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    shown = ops.display_text(src)
    return shown.withColumn("event_id", F.col("event_id").cast("bigint"))


@query("SELECT c_custkey, round(greatest(least(CASE WHEN abs(m) > 1e-9 THEN 10 * (v + s) / m ELSE v END, 50), 2), 4) AS marker_size "
       "FROM (SELECT c_custkey, v, abs(min(v) OVER ()) AS s, avg(v) OVER () + abs(min(v) OVER ()) AS m FROM "
       "(SELECT c_custkey, coalesce(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END, 0) AS v FROM customer))")
def marker_size(t):
    src = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("bal"))
    return rounded(ops.marker_size(src, "bal"), ["marker_size"]).select("c_custkey", "marker_size")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, "
       "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, "
       "CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 'big' ELSE 'small' END AS class FROM lineitem")
def recipe_apply(t):
    recipe = (Recipe().record("gone", "l_tax * 2").record("net", "l_extendedprice * (1 - l_discount)")
              .record("gross", "net * (1 + l_tax)").record("class", "if(net > 50000, 'big', 'small')").forget("gone"))
    out = apply_recipe(t.lineitem, recipe.to_json())
    return rounded(out.select("l_orderkey", "l_linenumber", "net", "gross", "class"), ["net", "gross"], 6)
