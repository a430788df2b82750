"""Pivot, melt, samples."""

from pyspark.sql import functions as F

from ..operators.reshape import list_rows, melt_table, pivot_table
from ..operators import reshape as wide, sample as smp
from .base import query, rounded

_SEGMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pivot(t, func):
    out = pivot_table(t.orders, "o_custkey", "o_orderstatus", "o_totalprice", func, order_by="o_orderkey")
    return out if func in ("count", "list") else rounded(out, ["F", "O", "P"], 7)


def _pivot_sql(expr, wrap="round({}, 7)"):
    cell = lambda s: wrap.format(expr.format(f"FILTER (o_orderstatus = '{s}')")) + f' AS "{s}"'
    return f"SELECT o_custkey, {cell('F')}, {cell('O')}, {cell('P')} FROM orders GROUP BY 1"


@query(_pivot_sql("sum(o_totalprice) {}"))
def pivot_sum(t):
    return _pivot(t, "sum")


@query(_pivot_sql("avg(o_totalprice) {}"))
def pivot_mean(t):
    return _pivot(t, "mean")


@query(_pivot_sql("median(o_totalprice) {}"))
def pivot_median(t):
    return _pivot(t, "median")


@query(_pivot_sql("min(o_totalprice) {}"))
def pivot_min(t):
    return _pivot(t, "min")


@query(_pivot_sql("max(o_totalprice) {}"))
def pivot_max(t):
    return _pivot(t, "max")


@query(_pivot_sql("count(o_totalprice) {}", "nullif({}, 0)"))
def pivot_count(t):
    return _pivot(t, "count")


@query(_pivot_sql("arg_min(o_totalprice, o_orderkey) {}"))
def pivot_first(t):
    return _pivot(t, "first")


@query(_pivot_sql("arg_max(o_totalprice, o_orderkey) {}"))
def pivot_last(t):
    return _pivot(t, "last")


@query("SELECT o_custkey, " + ", ".join(
    f"array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = '{s}'), ',') AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY 1")
def pivot_list(t):
    out = pivot_table(t.orders, "o_custkey", "o_orderstatus", "o_orderkey", "list", order_by="o_orderkey")
    return out.withColumns({s: F.array_join(F.col(s).cast("array<string>"), ",") for s in "FOP"})


_WIDE = ("WITH r AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS rank FROM (SELECT DISTINCT o_custkey FROM orders)), "
         "c AS (SELECT o_orderpriority, rank, o_custkey AS header, round(sum(o_totalprice), 4) AS cell FROM orders JOIN r USING (o_custkey) GROUP BY 1, 2, 3) ")


@query(_WIDE + "SELECT * FROM c")
def pivot_long(t):
    return rounded(wide.pivot_long(t.orders, "o_orderpriority", "o_custkey", "o_totalprice", "sum"), ["cell"])


@query("WITH r AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders) SELECT o_orderpriority, string_agg(rank || '=' || o_custkey, ',' ORDER BY rank) AS cells "
       "FROM orders JOIN r USING (o_orderkey) GROUP BY 1")
def pivot_arrays(t):
    """As many headers as orders."""
    out = wide.pivot_arrays(t.orders, "o_orderpriority", "o_orderkey", "o_custkey", "max")
    return out.select("o_orderpriority", F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["rank"].cast("string"), c["value"].cast("string"))), ",").alias("cells"))


@query(_WIDE + "SELECT o_orderpriority, rank // 50 AS \"group\", string_agg(coalesce(CAST(cell AS VARCHAR), '-'), ',' ORDER BY pos) AS cells FROM "
       "(SELECT p.o_orderpriority, p.g * 50 + pos AS rank, pos, round(cell) :: BIGINT AS cell FROM (SELECT DISTINCT o_orderpriority, rank // 50 AS g FROM c) p, range(0, 50) q(pos) "
       "LEFT JOIN c ON c.o_orderpriority = p.o_orderpriority AND c.rank = p.g * 50 + pos) GROUP BY 1, 2")
def pivot_groups(t):
    out = wide.pivot_groups(t.orders, "o_orderpriority", "o_custkey", "o_totalprice", "sum", width=50)
    cell = lambda v: F.coalesce(F.round(F.round(v, 4)).cast("bigint").cast("string"), F.lit("-"))
    return out.select("o_orderpriority", "group", F.array_join(F.transform("cells", cell), ",").alias("cells"))


@query("SELECT o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS position, "
       "o_custkey AS value FROM orders")
def pivot_list_rows(t):
    return list_rows(t.orders, "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) "
       "UNPIVOT (amount FOR measure IN (l_discount, l_tax))")
def melt_named(t):
    return melt_table(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"],
                      ["l_discount", "l_tax"], "measure", "amount")


@query("SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part) "
       "UNPIVOT (value FOR variable IN (p_name, p_brand, p_size))")
def melt_default(t):
    return melt_table(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), ["p_partkey"])


_Z = "1.959963984540054"


@query("SELECT CAST(greatest(1, least(ceil(CASE WHEN n > n0 THEN n0 / (1 + (n0 - 1) / n) ELSE n0 END), n)) AS BIGINT) AS sample_size FROM "
       f"(SELECT count(*) AS n, power({_Z} * stddev_samp(o_totalprice) / (0.05 * abs(avg(o_totalprice))), 2) AS n0 FROM orders)")
def sample_size_numeric(t):
    n = smp.column_sample_size(t.orders, "o_totalprice")
    return t.orders.agg(F.lit(n).cast("bigint").alias("sample_size"))


@query("SELECT CAST(greatest(1, least(ceil(CASE WHEN n > n0 THEN n0 / (1 + (n0 - 1) / n) ELSE n0 END), n)) AS BIGINT) AS sample_size FROM "
       "(SELECT count(*) AS n, power(2.5758293035489004, 2) * 0.25 / power(0.02, 2) AS n0 FROM lineitem)")
def sample_size_category(t):
    n = smp.column_sample_size(t.lineitem, "l_returnflag", 2, 99)
    return t.lineitem.agg(F.lit(n).cast("bigint").alias("sample_size"))


def _drawn(t, sample):
    """What a sample must satisfy whatever its rows: its size, no repeats, every row from the table."""
    known = sample.join(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], "left_semi")
    return known.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys"))


@query("SELECT least(10000, count(*)) AS rows, least(10000, count(*)) AS keys FROM orders")
def sample_exact(t):
    return _drawn(t, smp.sample_rows(t.orders, 10_000, key="o_orderkey"))


@query(f"SELECT n AS rows, n AS keys FROM (SELECT CAST(greatest(1, least(ceil(CASE WHEN n > n0 THEN n0 / (1 + (n0 - 1) / n) ELSE n0 END), n)) AS BIGINT) AS n "
       f"FROM (SELECT count(*) AS n, power({_Z} * stddev_samp(o_totalprice) / (0.05 * abs(avg(o_totalprice))), 2) AS n0 FROM orders))")
def sample_representative(t):
    return _drawn(t, smp.representative_sample(t.orders, "o_totalprice", key="o_orderkey"))


# The 64-bit hash that draws rows, as published (XXH64 of one 8-byte or 4-byte value), in whole numbers modulo 2^64.
_P = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def _hash_sql(names, source, keep):
    """SELECT of `keep` and the hash `h` over values given as (sql, bytes), one after the other, from 42."""
    wrap = lambda x: f"({x} % {2**64}::UHUGEINT)::UBIGINT"
    mul, add = (lambda a, b: wrap(f"{a}::UHUGEINT * {b}::UHUGEINT")), (lambda a, b: wrap(f"({a}::UHUGEINT + {b}::UHUGEINT)"))
    rot = lambda a, r: f"({a}::UHUGEINT * {2**r}::UHUGEINT % {2**64}::UHUGEINT + {a}::UHUGEINT // {2**(64 - r)}::UHUGEINT)::UBIGINT"
    seed, k = "42", 0

    def step(x):
        nonlocal k, source
        k += 1
        source = f"(SELECT *, {x} AS s{k} FROM {source})"
        return f"s{k}"

    for value, size in names:
        value = step(f"({value})::UBIGINT")
        h = step(add(add(seed, _P[4]), size))
        if size == 8:
            v = step(mul(step(rot(step(mul(value, _P[1])), 31)), _P[0]))
            h = step(add(step(mul(step(rot(step(f"xor({h}, {v})"), 27)), _P[0])), _P[3]))
        else:
            h = step(add(step(mul(step(rot(step(f"xor({h}, {step(mul(value, _P[0]))})"), 23)), _P[1])), _P[2]))
        for shift, by in ((33, _P[1]), (29, _P[2]), (32, None)):
            h = step(f"xor({h}, {h} >> {shift})")
            h = step(mul(h, by)) if by else h
        seed = h
    signed = f"CASE WHEN {seed} >= {2**63} THEN {seed}::HUGEINT - {2**64}::HUGEINT ELSE {seed}::HUGEINT END"
    return f"(SELECT {keep}, {seed} AS h, {signed} AS draw FROM {source})"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_hash_sql([('o_orderkey', 8), ('42', 4)], 'orders', '*')} QUALIFY row_number() OVER (ORDER BY draw, o_orderkey) <= 10000")
def sample_rows(t):
    return smp.sample_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 10_000, key="o_orderkey")


_CONTENT = [("l_linenumber", 4), ("l_suppkey", 8)]
_COUNTED = "(SELECT l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH a AS (SELECT l_linenumber, l_suppkey, n, h AS a FROM {_hash_sql([*_CONTENT, ('1', 4)], _COUNTED, '*')}), "
       f"b AS (SELECT l_linenumber, l_suppkey, n, a, h AS b FROM {_hash_sql([*_CONTENT, ('2', 4)], 'a', '*')}), "
       "c AS (SELECT l_linenumber, l_suppkey, a, b, unnest(range(0, n)) AS i FROM b) "
       f"SELECT l_linenumber, l_suppkey FROM {_hash_sql([('a', 8), ('b', 8), ('i', 8), ('7', 4)], 'c', 'l_linenumber, l_suppkey, i')} QUALIFY row_number() OVER (ORDER BY draw, i) <= 5000")
def sample_by_content(t):
    """Rows without a key, most of them repeated."""
    return smp.sample_rows(t.lineitem.select("l_linenumber", "l_suppkey"), 5000, seed=7)
