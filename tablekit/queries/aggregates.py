"""Grouped summaries, profiles and window values."""

from pyspark.sql import functions as F

from ..operators import profile as prof, windows as win
from ..operators.aggregate import count_by, group_summary, sum_by
from .base import query, rounded


def _bar(t, func):
    out = group_summary(t.orders, ["o_orderpriority", "o_orderstatus"], func, "o_totalprice", order_by="o_orderkey")
    return out if func == "count" else rounded(out, ["value"])


def _bar_sql(expr):
    return f"SELECT o_orderpriority, o_orderstatus, {expr} AS value FROM orders GROUP BY 1, 2"


@query(_bar_sql("round(sum(o_totalprice), 4)"))
def bar_sum(t):
    return _bar(t, "sum")


@query(_bar_sql("round(avg(o_totalprice), 4)"))
def bar_mean(t):
    return _bar(t, "mean")


@query(_bar_sql("round(median(o_totalprice), 4)"))
def bar_median(t):
    return _bar(t, "median")


@query(_bar_sql("round(min(o_totalprice), 4)"))
def bar_min(t):
    return _bar(t, "min")


@query(_bar_sql("round(max(o_totalprice), 4)"))
def bar_max(t):
    return _bar(t, "max")


@query(_bar_sql("count(*)"))
def bar_count(t):
    return _bar(t, "count")


@query(_bar_sql("round(arg_min(o_totalprice, o_orderkey), 4)"))
def bar_first(t):
    return _bar(t, "first")


@query(_bar_sql("round(arg_max(o_totalprice, o_orderkey), 4)"))
def bar_last(t):
    return _bar(t, "last")


@query("SELECT o_custkey, count(*) AS value, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, "
       "arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def bar_carry_first(t):
    return group_summary(t.orders, ["o_custkey"], "count", carry=["o_orderpriority", "o_orderstatus"], order_by="o_orderkey")


@query("SELECT o_orderpriority, o_orderstatus, round(median(TRY_CAST(v AS DOUBLE)), 4) AS value FROM "
       "(SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders) GROUP BY 1, 2")
def bar_lenient_text(t):
    v = F.when(F.col("o_orderkey") % 8 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    return rounded(group_summary(t.orders.withColumn("v", v), ["o_orderpriority", "o_orderstatus"], "median", "v"), ["value"])


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def agg_count_by(t):
    return count_by(t.events, "event_type")


@query("SELECT event_type, round(sum(value), 4) AS sum FROM events GROUP BY 1")
def agg_sum_by(t):
    return rounded(sum_by(t.events, "event_type", "value"), ["sum"])


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def value_counts_top10(t):
    return prof.value_counts(t.orders, "o_custkey")


@query("SELECT event_type, count(*) AS count FROM (SELECT nullif(event_type, 'view') AS event_type FROM events) GROUP BY 1")
def value_counts_null(t):
    return prof.value_counts(t.events.select(F.nullif(F.col("event_type"), F.lit("view")).alias("event_type")), "event_type")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#2'")
def category_domain(t):
    return prof.category_domain(t.part.select(F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand")), "p_brand")


@query("SELECT 'l_partkey' AS \"column\", count(DISTINCT l_partkey) AS n_unique FROM lineitem UNION ALL "
       "SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL "
       "SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem UNION ALL "
       "SELECT 'flag', count(DISTINCT nullif(l_linestatus, 'O')) + max((l_linestatus = 'O')::INT) FROM lineitem")
def distinct_count(t):
    src = t.lineitem.withColumn("flag", F.nullif(F.col("l_linestatus"), F.lit("O")))
    return prof.distinct_count(src, ["l_partkey", "l_returnflag", "l_shipdate", "flag"])


_FILL = ("SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
         "round(count({c}) * 100.0 / count(*), 4) AS fill_pct, "
         "round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct FROM s")


@query("WITH s AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice "
       "END AS pr FROM orders) " + " UNION ALL ".join(_FILL.format(c=c) for c in ("o_orderkey", "st", "pr")))
def profile_fill(t):
    src = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("st"),
                          F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("pr"))
    return rounded(prof.fill_profile(src), ["fill_pct", "null_pct"])


_NUM = ("SELECT '{c}' AS \"column\", count({c}) AS count, round(CAST(sum({c}) AS DOUBLE), 4) AS sum, round(avg({c}), 4) AS mean, "
        "round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS variance, CAST(min({c}) AS DOUBLE) AS min, "
        "CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} > 0) AS positive, "
        "count(*) FILTER ({c} < 0) AS negative, round(quantile_cont({c}, 0.25), 4) AS q1, "
        "round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem")


@query(" UNION ALL ".join(_NUM.format(c=c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def profile_numeric(t):
    out = prof.numeric_profile(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return rounded(rounded(out, ["sum", "mean", "std", "q1", "median", "q3"]), ["variance"], 2)


_SPAN = ("SELECT '{c}' AS \"column\", strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS latest, "
         "CAST(floor(date_sub('second', min({c}), max({c})) / 86400.0) AS BIGINT) AS d FROM {t}")


@query("SELECT \"column\", earliest, latest, d AS total_days, d // 365 AS years, d % 365 // 30 AS months, d % 365 % 30 AS days FROM ("
       + _SPAN.format(c="o_orderdate", t="orders") + ") UNION ALL SELECT \"column\", earliest, latest, d, d // 365, d % 365 // 30, "
       "d % 365 % 30 FROM (" + _SPAN.format(c="ts", t="events") + ")")
def profile_datetime(t):
    out = prof.datetime_profile(t.orders, ["o_orderdate"]).unionByName(prof.datetime_profile(t.events, ["ts"]))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("earliest", "latest")})


_DESCRIBE = [
    ("count", "count(p_size)", "count(p_retailprice)", "count(b)"),
    ("null_count", "count(*) - count(p_size)", "count(*) - count(p_retailprice)", "count(*) - count(b)"),
    ("mean", "avg(p_size)", "avg(p_retailprice)", "NULL"),
    ("std", "stddev_samp(p_size)", "stddev_samp(p_retailprice)", "NULL"),
    ("min", "min(p_size)", "min(p_retailprice)", "min(b)"),
    ("25%", "quantile_cont(p_size, 0.25)", "quantile_cont(p_retailprice, 0.25)", "NULL"),
    ("50%", "quantile_cont(p_size, 0.5)", "quantile_cont(p_retailprice, 0.5)", "NULL"),
    ("75%", "quantile_cont(p_size, 0.75)", "quantile_cont(p_retailprice, 0.75)", "NULL"),
    ("max", "max(p_size)", "max(p_retailprice)", "max(b)"),
]


@query("WITH s AS (SELECT p_size, p_retailprice, nullif(p_brand, 'Brand#1') AS b FROM part) " + " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, round(CAST({a} AS DOUBLE), 4) AS p_size, round(CAST({b} AS DOUBLE), 4) AS p_retailprice, "
    f"CAST({c} AS VARCHAR) AS b FROM s" for n, a, b, c in _DESCRIBE))
def describe_table(t):
    src = t.part.select("p_size", "p_retailprice", F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("b"))
    out = prof.describe_table(src)
    return out.withColumns({c: F.round(F.col(c).try_cast("double"), 4) for c in ("p_size", "p_retailprice")})


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price, round(sum(l_extendedprice) OVER (PARTITION BY l_returnflag, "
       "l_linestatus), 2) AS total FROM lineitem")
def win_sum(t):
    out = win.sum_over(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "total")
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("price"), F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS mean, count(*) OVER (PARTITION BY o_custkey) AS n, "
       "max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def win_aggregates(t):
    out = win.aggregate_over(t.orders, ["o_custkey"], {"mean": F.avg("o_totalprice"), "n": F.count("*"), "top": F.max("o_totalprice")})
    return rounded(out.select("o_orderkey", "mean", "n", "top"), ["mean"], 7)


@query("SELECT l_orderkey, l_partkey, l_quantity, CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) + "
       "(count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS DOUBLE) AS place FROM lineitem")
def win_rank_desc(t):
    return win.rank_over(t.lineitem, ["l_suppkey"], "l_quantity", "place").select(
        "l_orderkey", "l_partkey", "l_quantity", F.col("place").cast("double").alias("place"))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS place FROM part")
def win_rank_dense(t):
    return win.rank_over(t.part, ["p_brand"], "p_size", "place", descending=False, method="dense") \
        .select("p_partkey", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_id, first(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type FROM events")
def win_first(t):
    return win.first_over(t.events, ["user_id"], "event_type", "first_type", "event_id").select("event_id", "first_type")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def win_cumsum(t):
    return rounded(win.cumulative_sum(t.events, ["user_id"], "value", "running", "event_id").select("event_id", "running"), ["running"])
