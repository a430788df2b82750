"""Tables behind charts."""

from pyspark.sql import functions as F

from ..operators import charts as ch
from .base import query, rounded, text_of



@query("SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS hover_l_shipdate, "
       "CAST(l_partkey AS VARCHAR) AS hover_l_partkey FROM lineitem")
def points_scatter(t):
    return ch.points_table(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag", hover=["l_shipdate", "l_partkey"])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x, o_totalprice AS y, o_orderstatus AS facet_row FROM orders WHERE o_orderstatus <> 'P'")
def points_line_facet(t):
    src = t.orders.withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return ch.points_table(src, "o_orderdate", "o_totalprice", facet_row="o_orderstatus", sort_x=True).withColumn("x", text_of(F.col("x")))


@query("SELECT p_brand AS x, p_retailprice AS y, p_type AS color FROM part")
def points_strip(t):
    return ch.points_table(t.part, "p_brand", "p_retailprice", "p_type")


@query("SELECT p_partkey, p_type || ' (' || p_brand || ')' AS series, dense_rank() OVER (ORDER BY p_type) - 1 AS series_index, dense_rank() OVER (ORDER BY p_brand) - 1 AS pattern_index FROM part WHERE p_brand <> 'Brand#3'")
def series_split(t):
    src = t.part.select("p_partkey", "p_type", F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("b"))
    return ch.series_table(src, color="p_type", pattern="b").select("p_partkey", "series", "series_index", "pattern_index")


@query("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS value, "
       "round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def bar_relative(t):
    out = ch.bar_table(t.orders, "o_orderpriority", "o_totalprice", "sum", color="o_orderstatus", mode="relative")
    return rounded(rounded(out, ["value"], 2), ["share"], 6)


@query("SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS value FROM lineitem GROUP BY 1, 2, 3")
def facet_bars(t):
    return ch.bar_table(t.lineitem.withColumn("y", F.year("l_shipdate")), "l_returnflag", None, "count", color="l_linestatus", facet_col="y")


@query("SELECT c_mktsegment, count(*) AS value, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM customer GROUP BY 1")
def pie_count(t):
    return rounded(ch.pie_table(t.customer, "c_mktsegment"), ["percent"])


@query("SELECT event_type, round(sum(value), 4) AS value, round(sum(value) * 100.0 / sum(sum(value)) OVER (), 4) AS percent FROM events GROUP BY 1")
def pie_sum(t):
    return rounded(ch.pie_table(t.events, "event_type", "value"), ["value", "percent"])


_HIST = ("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), "
         "c AS (SELECT {s} least(CAST(floor((o_totalprice - lo) / ((hi - lo) / {n})) AS INTEGER), {n} - 1) AS bin, {v} AS v FROM orders, r GROUP BY ALL), "
         "g AS (SELECT {d} CAST(bin AS INTEGER) AS bin, lo + bin * ((hi - lo) / {n}) AS lo, lo + (bin + 1) * ((hi - lo) / {n}) AS hi FROM r, "
         "range(0, {n}) q(bin) {cross}) ")


@query(_HIST.format(s="", d="", cross="", n=10, v="count(*)") + "SELECT g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, "
       "CAST(coalesce(v, 0) AS DOUBLE) AS value FROM g LEFT JOIN c ON g.bin = c.bin")
def hist_counts(t):
    return rounded(ch.histogram_table(t.orders, "o_totalprice"), ["lo", "hi"])


_SPLIT = _HIST.format(s="o_orderstatus,", d="o_orderstatus,", cross=", (SELECT DISTINCT o_orderstatus FROM orders)", n=25, v="count(*)")


@query(_SPLIT + "SELECT g.o_orderstatus, g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, round(coalesce(v, 0) * 100.0 / "
       "sum(v) OVER (PARTITION BY g.o_orderstatus), 6) AS value FROM g LEFT JOIN c ON g.bin = c.bin AND g.o_orderstatus = c.o_orderstatus")
def hist_percent(t):
    return rounded(rounded(ch.histogram_table(t.orders, "o_totalprice", 25, color="o_orderstatus", norm="percent"), ["lo", "hi"]), ["value"], 6)


@query(_SPLIT + "SELECT g.o_orderstatus, g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, round(1e6 * coalesce(v, 0) / "
       "(sum(v) OVER (PARTITION BY g.o_orderstatus) * (g.hi - g.lo)), 6) AS value FROM g LEFT JOIN c ON g.bin = c.bin AND g.o_orderstatus = c.o_orderstatus")
def hist_probability_density(t):
    out = ch.histogram_table(t.orders, "o_totalprice", 25, color="o_orderstatus", norm="probability density")
    return rounded(rounded(out.withColumn("value", F.col("value") * 1e6), ["lo", "hi"]), ["value"], 6)


@query(_SPLIT + "SELECT g.o_orderstatus, g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, round(sum(coalesce(v, 0)) OVER (PARTITION BY "
       "g.o_orderstatus ORDER BY g.bin) / sum(v) OVER (PARTITION BY g.o_orderstatus), 6) AS value FROM g LEFT JOIN c "
       "ON g.bin = c.bin AND g.o_orderstatus = c.o_orderstatus")
def hist_cumulative(t):
    out = ch.histogram_table(t.orders, "o_totalprice", 25, color="o_orderstatus", norm="probability", cumulative=True)
    return rounded(rounded(out, ["lo", "hi"]), ["value"], 6)


_MANY = _HIST.format(s="o_orderstatus,", d="o_orderstatus,", cross=", (SELECT DISTINCT o_orderstatus FROM orders)", n=20_000, v="count(*)")


@query(_MANY + "SELECT g.o_orderstatus, g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, CAST(sum(coalesce(v, 0)) OVER (PARTITION BY g.o_orderstatus ORDER BY g.bin) AS DOUBLE) AS value "
       "FROM g LEFT JOIN c ON g.bin = c.bin AND g.o_orderstatus = c.o_orderstatus")
def hist_many_bins(t):
    return rounded(ch.histogram_table(t.orders, "o_totalprice", 20_000, color="o_orderstatus", cumulative=True), ["lo", "hi"])


@query(_HIST.format(s="", d="", cross="", n=12, v="sum(o_custkey)") + "SELECT g.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, "
       "CAST(coalesce(v, 0) AS DOUBLE) AS value FROM g LEFT JOIN c ON g.bin = c.bin")
def hist_weighted(t):
    return rounded(ch.histogram_table(t.orders, "o_totalprice", 12, weight="o_custkey"), ["lo", "hi"])


@query("WITH v AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::DOUBLE AS v FROM lineitem), r AS (SELECT min(v) AS lo, max(v) AS hi, "
       "CAST(ceil(log2(count(*))) AS INTEGER) + 1 AS n FROM v), c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / n)) AS INTEGER), n - 1) AS bin, "
       "count(*) AS k FROM v, r GROUP BY 1) SELECT CAST(q.bin AS INTEGER) AS bin, round(lo + q.bin * ((hi - lo) / n), 4) AS lo, "
       "round(lo + (q.bin + 1) * ((hi - lo) / n), 4) AS hi, CAST(coalesce(k, 0) AS DOUBLE) AS value FROM r, range(0, 1000) q(bin) "
       "LEFT JOIN c ON c.bin = q.bin WHERE q.bin < n")
def hist_temporal_auto(t):
    return rounded(ch.histogram_table(t.lineitem, "l_shipdate", 0), ["lo", "hi"])


# The square spreads the prices so that there are outliers.
_SQUARED = "SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice * o_totalprice * o_totalprice / 1e9 AS y FROM orders"


def _squared(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", (p * p * p / 1e9).alias("y"))


_FENCES = (f"WITH s AS ({_SQUARED}), q AS (SELECT o_orderpriority, o_orderstatus, quantile_cont(y, 0.25) AS q1, median(y) AS med, "
           "quantile_cont(y, 0.75) AS q3 FROM s GROUP BY 1, 2), f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS lf, q3 + (q3 - q1) * 1.5 AS uf FROM q) ")


@query(_FENCES + "SELECT s.o_orderpriority, s.o_orderstatus, count(*) AS count, round(min(y), 4) AS min, round(any_value(q1), 4) AS q1, "
       "round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, round(max(y), 4) AS max, round(any_value(lf), 4) AS lower_fence, "
       "round(any_value(uf), 4) AS upper_fence, round(min(y) FILTER (y >= lf), 4) AS lower_whisker, round(max(y) FILTER (y <= uf), 4) AS upper_whisker, "
       "count(*) FILTER (y < lf OR y > uf) AS outliers FROM s JOIN f ON s.o_orderpriority = f.o_orderpriority AND s.o_orderstatus = f.o_orderstatus GROUP BY 1, 2")
def box_stats(t):
    out = ch.box_table(_squared(t), "y", "o_orderpriority", "o_orderstatus")
    return rounded(out, ["min", "q1", "median", "q3", "max", "lower_fence", "upper_fence", "lower_whisker", "upper_whisker"])


@query(_FENCES + "SELECT s.o_orderpriority, s.o_orderstatus, round(y, 4) AS value FROM s JOIN f ON s.o_orderpriority = f.o_orderpriority AND "
       "s.o_orderstatus = f.o_orderstatus WHERE y < lf OR y > uf")
def box_outliers(t):
    return rounded(ch.box_outliers(_squared(t), "y", "o_orderpriority", "o_orderstatus"), ["value"])


@query("WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) "
       "SELECT least(CAST(floor((l_quantity - x0) / ((x1 - x0) / 15)) AS INTEGER), 14) AS x_bin, "
       "least(CAST(floor((l_extendedprice - y0) / ((y1 - y0) / 12)) AS INTEGER), 11) AS y_bin, count(*) AS value FROM lineitem, r GROUP BY 1, 2")
def density_grid(t):
    return ch.density_table(t.lineitem, "l_quantity", "l_extendedprice", 15, 12)


@query("WITH v AS (SELECT 'l_quantity' AS \"column\", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem), "
       "r AS (SELECT \"column\", min(v) AS lo, (max(v) - min(v)) / 20 AS w, max(v) AS hi, count(*) AS n FROM v GROUP BY 1) "
       "SELECT \"column\", bin, round(any_value(lo) + bin * any_value(w), 6) AS bin_start, round(any_value(w), 6) AS width, count(*) AS count, "
       "round(count(*) / (any_value(n) * any_value(w)), 6) AS density FROM (SELECT \"column\", lo, w, n, "
       "least(CAST(floor((v - lo) / w) AS BIGINT), greatest(CAST(ceil((hi - lo) / w) AS BIGINT) - 1, 0)) AS bin FROM v JOIN r USING (\"column\")) GROUP BY 1, 2")
def dist_histogram(t):
    out = ch.distribution_histogram(t.lineitem, ["l_quantity", "l_tax"], 20)
    return rounded(out, ["bin_start", "width", "density"], 6)


@query("WITH v AS (SELECT 'o_totalprice' AS \"column\", o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders), "
       "r AS (SELECT \"column\", min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd FROM v GROUP BY 1), "
       "g AS (SELECT *, CAST(p AS INTEGER) AS point, lo + p * ((hi - lo) / 500) AS x FROM r, range(0, 500) q(p)) "
       "SELECT \"column\", point, round(x, 4) AS x, round(1e6 * exp(-((x - mu) / sd) * ((x - mu) / sd) / 2) / (sd * sqrt(2.0 * pi())), 4) AS density FROM g")
def dist_normal(t):
    out = ch.normal_curve(t.orders, ["o_totalprice", "o_custkey"])
    return rounded(out.withColumn("density", F.col("density") * 1e6), ["x", "density"])


# The sum over all rows, point by point.
_KDE = ("r AS (SELECT k, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * power(count(*), -0.2) AS band FROM v GROUP BY 1), "
        "w AS (SELECT k, v, count(*) AS w FROM v GROUP BY 1, 2), "
        "g AS (SELECT *, CAST(p AS INTEGER) AS point, lo + p * ((hi - lo) / {p}) AS x FROM r, range(0, {p}) q(p)) "
        "SELECT g.k AS {k}, point, round(x, 4) AS x, round({f} * sum(w * exp(-((x - v) / band) * ((x - v) / band) / 2)) / (any_value(band) * any_value(n) * "
        "sqrt(2.0 * pi())), 7) AS density FROM g JOIN w ON g.k = w.k GROUP BY g.k, point, x")


@query("WITH v AS (SELECT 'l_quantity' AS k, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem), "
       + _KDE.format(p=500, k='"column"', f=1))
def dist_kde(t):
    return rounded(rounded(ch.distribution_kde(t.lineitem, ["l_quantity", "l_linenumber"]), ["x"]), ["density"], 7)


@query("WITH v AS (SELECT c_mktsegment AS k, c_acctbal AS v FROM customer), " + _KDE.format(p=100, k="c_mktsegment", f=1e6))
def violin_density(t):
    curve = ch.kde_curve(t.customer, "c_acctbal", ["c_mktsegment"], 100)
    return rounded(rounded(curve.withColumn("density", F.col("density") * 1e6), ["x"]), ["density"], 7)


@query("WITH v AS (SELECT 0 AS k, l_extendedprice AS v FROM lineitem), " + _KDE.format(p=60, k="one", f=1e6))
def dist_kde_prices(t):
    """As many distinct values as rows, and no groups."""
    curve = ch.kde_curve(t.lineitem, "l_extendedprice", points=60).withColumn("one", F.lit(0))
    return rounded(rounded(curve.withColumn("density", F.col("density") * 1e6), ["x"]), ["density"], 7)


@query("WITH s AS (SELECT c_mktsegment, c_nationkey % 2 = 0 AS even, c_acctbal AS y FROM customer), q AS (SELECT c_mktsegment, even, count(*) AS n, min(y) AS mn, "
       "max(y) AS mx, quantile_cont(y, 0.25) AS q1, median(y) AS med, quantile_cont(y, 0.75) AS q3 FROM s GROUP BY 1, 2) "
       "SELECT c_mktsegment, even, n AS count, mn AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, mx AS max FROM q")
def violin_box(t):
    src = t.customer.withColumn("even", F.col("c_nationkey") % 2 == 0)
    box, _ = ch.violin_table(src, "c_acctbal", "c_mktsegment", split="even")
    return rounded(box.select("c_mktsegment", "even", "count", "min", "q1", "median", "q3", "max"), ["q1", "median", "q3"])


@query("SELECT 'ts' AS \"column\", round(date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 86400000000.0, 5) AS value FROM events")
def rug_temporal_days(t):
    return rounded(ch.rug_table(t.events, ["ts"]), ["value"], 5)


@query("WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)) AS y0, "
       "max(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)) AS y1 FROM lineitem) SELECT least(CAST(floor((l_quantity - x0) / ((x1 - x0) / 20)) AS INTEGER), 19) AS x_bin, "
       "least(CAST(floor((date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) - y0) / ((y1 - y0) / 20.0)) AS INTEGER), 19) AS y_bin, "
       "CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem, r GROUP BY 1, 2")
def density_weighted_temporal(t):
    return ch.density_table(t.lineitem, "l_quantity", "l_shipdate", weight="l_linenumber")


@query("WITH v AS (SELECT 'o_orderdate' AS \"column\", date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate)::DOUBLE AS v FROM orders), "
       "r AS (SELECT \"column\", min(v) AS lo, 30.0 AS w, max(v) AS hi, count(*) AS n FROM v GROUP BY 1) "
       "SELECT \"column\", bin, round(any_value(lo) + bin * 30.0, 6)::DOUBLE AS bin_start, 30.0::DOUBLE AS width, count(*) AS count, "
       "round(count(*) / (any_value(n) * 30.0), 6)::DOUBLE AS density FROM (SELECT \"column\", lo, n, "
       "least(CAST(floor((v - lo) / w) AS BIGINT), greatest(CAST(ceil((hi - lo) / w) AS BIGINT) - 1, 0)) AS bin FROM v JOIN r USING (\"column\")) GROUP BY 1, 2")
def dist_histogram_temporal(t):
    return rounded(ch.distribution_histogram(t.orders, ["o_orderdate"], bin_width=30.0), ["bin_start", "density"], 6)


@query("SELECT round(median(o_totalprice), 4) AS median, count(*) AS count, round(min(o_totalprice), 4) AS min FROM orders")
def box_ungrouped(t):
    return rounded(ch.box_table(t.orders, "o_totalprice").select("median", "count", "min"), ["median", "min"])
