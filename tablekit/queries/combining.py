"""Joins and concatenation."""

from pyspark.sql import functions as F

from ..operators import combine as comb
from ..operators.joins import join_tables
from ..plans.layout import with_row_id
from .base import query


@query("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t):
    out = join_tables(t.customer, t.orders, "c_custkey", "o_custkey")
    return out.select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders "
       "ON c_custkey = o_custkey + 700")
def join_left(t):
    shifted = t.orders.select((F.col("o_custkey") + 700).alias("o_custkey"), "o_orderkey")
    return join_tables(t.customer.select("c_custkey", "c_mktsegment"), shifted, "c_custkey", "o_custkey", "left")


_OUTER = ("(SELECT c_custkey AS k, c_name FROM customer) a FULL JOIN "
          "(SELECT o_custkey + 700 AS k, o_orderkey FROM orders) b ON a.k = b.k")


def _outer_sides(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    return left, t.orders.select((F.col("o_custkey") + 700).alias("k"), "o_orderkey")


@query(f"SELECT a.k, c_name, b.k AS k_other, o_orderkey FROM {_OUTER}")
def join_outer(t):
    return join_tables(*_outer_sides(t), "k", how="outer")


@query(f"SELECT coalesce(a.k, b.k) AS k, c_name, o_orderkey FROM {_OUTER}")
def join_outer_coalesced(t):
    return join_tables(*_outer_sides(t), "k", how="outer", coalesce_keys=True)


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey + 700")
def join_semi(t):
    return join_tables(t.customer.select("c_custkey", "c_name"), t.orders.select((F.col("o_custkey") + 700).alias("o_custkey")), "c_custkey", "o_custkey", "semi")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 700 FROM lineitem)")
def join_anti(t):
    return join_tables(t.part.select("p_partkey", "p_name"), t.lineitem.select((F.col("l_partkey") + 700).alias("l_partkey")), "p_partkey", "l_partkey", "anti")


@query("SELECT c_custkey, r_regionkey, r_name FROM customer CROSS JOIN region")
def join_cross(t):
    return join_tables(t.customer.select("c_custkey"), t.region, how="cross")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey "
       "AND a.l_linenumber = b.l_suppkey")
def join_multikey(t):
    right = t.lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), "l_tax")
    return join_tables(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), right, ["l_orderkey", "l_linenumber"], ["ok", "sk"])


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, s_name AS name_other, s_acctbal AS bal_other FROM customer JOIN supplier "
       "ON c_custkey = s_suppkey")
def join_suffix(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    right = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return join_tables(left, right, "k")


@query("SELECT a.c_custkey, b.n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer) a LEFT JOIN "
       "(SELECT nullif(n_nationkey, 5) AS nk, n_name FROM nation) b ON a.nk = b.nk")
def join_null_keys(t):
    left = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nk"))
    right = t.nation.select(F.nullif(F.col("n_nationkey"), F.lit(5)).alias("nk"), "n_name")
    return join_tables(left, right, "nk", how="left").drop("nk")


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def union_strict(t):
    src = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    cols = ["o_orderkey", "o_totalprice"]
    return comb.stack_strict(src.select(cols), src.select(cols))


def _people(t):
    left = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("code"), "c_mktsegment")
    right = t.supplier.select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").alias("bal"),
                              F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("code"))
    return left, right


_PEOPLE = ("SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS code, c_mktsegment, CAST(NULL AS DOUBLE) AS bal "
           "FROM customer UNION ALL SELECT s_suppkey, s_name, 'N' || CAST(s_nationkey AS VARCHAR), NULL, s_acctbal FROM supplier")


@query(_PEOPLE)
def union_relaxed(t):
    return comb.stack_relaxed(*_people(t))


@query(_PEOPLE)
def union_diagonal(t):
    return comb.concat_tables(*_people(t), how="diagonal_relaxed")


@query("SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_common(t):
    left = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    right = t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), "s_nationkey")
    return comb.stack_common(left, right)


@query("SELECT c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier")
def union_matched_names(t):
    named = comb.rename_like(t.supplier.drop("s_suppkey"), t.customer, 60)
    return comb.stack_common(t.customer, named)


@query("SELECT coalesce(a.r, b.r) AS _row_id, c_name, s_name, s_acctbal FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS r "
       "FROM customer) a FULL JOIN (SELECT s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS r FROM supplier) b "
       "ON a.r = b.r")
def concat_horizontal(t):
    left = with_row_id(t.customer.select("c_custkey", "c_name"), "c_custkey").drop("c_custkey")
    right = with_row_id(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), ["s_acctbal", "s_suppkey"]).drop("s_suppkey")
    return comb.beside(left, right)


@query("SELECT coalesce(a.r, b.r) AS _row_id, c_name AS title, s_name AS title_right, s_acctbal AS \"Acct_Bal\" FROM (SELECT c_name, "
       "row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) a FULL JOIN (SELECT s_name, s_acctbal, row_number() OVER "
       "(ORDER BY s_suppkey) - 1 AS r FROM supplier) b ON a.r = b.r")
def concat_horizontal_mapped(t):
    left = with_row_id(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Name"),
                                         F.col("c_acctbal").alias("Acct_Bal")), "id")
    right = with_row_id(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                          F.col("s_acctbal").alias("acctbal")), "id")
    by_name = {m.current: m.other for m in comb.default_mapping(left.columns, right.columns)}
    return comb.beside(left, right, [comb.ColumnMap("Name", by_name["Name"], output="title"),
                                     comb.ColumnMap("Acct_Bal", by_name["Acct_Bal"], include_current=False)])


def _balances(t):
    left = t.customer.select((F.col("c_custkey") + 5).alias("k"), F.col("c_acctbal").alias("bal"), "c_name")
    return left, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))


def _align_sql(kind):
    return ("SELECT coalesce(a.k, b.k) AS k, a.bal, c_name, b.bal AS bal_right FROM (SELECT c_custkey + 5 AS k, c_acctbal AS bal, c_name FROM customer"
            f") a {kind} JOIN (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier) b ON a.k = b.k")


@query(_align_sql("FULL"))
def align_full(t):
    return comb.align(*_balances(t))


@query(_align_sql("INNER"))
def align_inner(t):
    return comb.align(*_balances(t), how="inner")


@query(_align_sql("LEFT"))
def align_left(t):
    return comb.align(*_balances(t), how="left")


@query(_align_sql("RIGHT"))
def align_right(t):
    return comb.concat_tables(*_balances(t), how="align_right", partitions=4)
