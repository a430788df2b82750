"""Scalar functions whose meaning differs from the Spark built-in of the same name, next to plain built-ins."""

from pyspark.sql import functions as F

from .. import functions as fn
from .base import query, text_of




@query("SELECT p_partkey, p_name || ' - ' || CAST(p_size AS VARCHAR) AS labelled, p_brand || '|' || p_type AS joined, upper(p_name) AS up, "
       "starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends, CAST(strlen(p_name) AS INTEGER) AS bytes, "
       "CAST(length(p_name) AS INTEGER) AS chars, substring(p_name, 3, 4) AS mid, right(p_name, 3) AS tail, lpad(CAST(p_size AS VARCHAR), CAST(greatest(6, length(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS zeros, "
       "rpad(p_name, CAST(greatest(8, length(p_name)) AS INTEGER), '.') AS padded, trim(p_name, 'rs') AS stripped FROM part")
def fn_string(t):
    size = F.col("p_size").cast("string")
    return t.part.select(
        "p_partkey", fn.format_text("{} - {}", "p_name", "p_size").alias("labelled"),
        fn.concat_str("p_brand", "p_type", separator="|").alias("joined"), F.upper(F.col("p_name")).alias("up"),
        F.startswith(F.col("p_name"), F.lit("red")).alias("starts"), F.endswith(F.col("p_name"), F.lit("ring")).alias("ends"), F.octet_length(F.col("p_name")).alias("bytes"),
        F.char_length(F.col("p_name")).alias("chars"), fn.slice_text(F.col("p_name"), 2, 4).alias("mid"), fn.slice_text(F.col("p_name"), -3).alias("tail"),
        fn.zfill(size, 6).alias("zeros"), fn.pad_end(F.col("p_name"), 8, ".").alias("padded"), F.btrim(F.col("p_name"), F.lit("rs")).alias("stripped"))


@query(r"SELECT page_id, regexp_matches(url, '[?&]page=\d+') AS has_page, CASE WHEN regexp_matches(url, 'page=(\d+)') THEN regexp_extract(url, 'page=(\d+)', 1) END AS page, "
       r"regexp_replace(url, '[aeiou]', '_', 'g') AS masked, regexp_replace(url, '[aeiou]', '_') AS first_masked, string_split(url, '/')[3] AS host, "
       r"string_split(url, '/')[20] AS missing, string_split(url, '.')[1] AS dotted, string_split(url, '.')[2] AS dotted_two FROM pages")
def fn_regex(t):
    url = F.col("url")
    pieces = fn.split_exact(url, ".", 1)
    return t.pages.select(
        "page_id", url.rlike(r"[?&]page=\d+").alias("has_page"), fn.extract(url, r"page=(\d+)").alias("page"),
        F.regexp_replace(url, "[aeiou]", "_").alias("masked"), fn.replace_first(url, "[aeiou]", "_").alias("first_masked"),
        fn.list_get(fn.split_literal(url, "/"), 2).alias("host"), fn.list_get(fn.split_literal(url, "/"), 19).alias("missing"),
        pieces["field_0"].alias("dotted"), pieces["field_1"].alias("dotted_two"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, "
       "CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(microsecond(ts) % 1000000 AS INTEGER) AS us, "
       "CAST(isodow(ts) AS INTEGER) AS weekday, CAST(weekofyear(ts) AS INTEGER) AS week, CAST(dayofyear(ts) AS INTEGER) AS ordinal, "
       "strftime(ts, '%A, %B %d, %Y %H:%M') AS written, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def fn_datetime(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("mo"), F.day(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"),
        F.second(ts).alias("s"), fn.date_part_us(ts).alias("us"), fn.iso_weekday(ts).alias("weekday"), F.weekofyear(ts).alias("week"),
        F.dayofyear(ts).alias("ordinal"), fn.strftime(ts, "%A, %B %d, %Y %H:%M").alias("written"),
        text_of(ts + F.make_dt_interval(F.lit(1), F.lit(12))).alias("later"))


@query("SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS month, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week, "
       "strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS quarter_hour, "
       "strftime(time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 30 MINUTE, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS nearest_hour, "
       "strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS next_month, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier, "
       "strftime(date_trunc('day', ts) + INTERVAL 510 MINUTE, '%Y-%m-%d %H:%M:%S') AS at_half_past_eight FROM events")
def fn_datetime_buckets(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", text_of(fn.truncate(ts, "1mo")).alias("month"), text_of(fn.truncate(ts, "1w")).alias("week"),
        text_of(fn.truncate(ts, "15m")).alias("quarter_hour"), text_of(fn.round_to(ts, "1h")).alias("nearest_hour"),
        text_of(fn.offset_by(ts, "1mo")).alias("next_month"), text_of(fn.offset_by(ts, "-1h30m")).alias("earlier"),
        text_of(fn.combine(ts, F.lit("08:30:00"))).alias("at_half_past_eight"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def fn_parse_dates(t):
    raw = F.when(F.col("o_orderkey") % 6 == 0, "later").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return t.orders.select("o_orderkey", F.date_format(fn.to_date_text(raw, "%d.%m.%Y"), "yyyy-MM-dd").alias("day"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS rounded, round(abs(l_tax - 0.04), 4) AS gap, round(ln(l_quantity), 6) AS ln, "
       "round(exp(l_discount), 6) AS e, round(power(l_quantity, 2), 4) AS squared, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS ratio, "
       "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey % (l_linenumber - 1) END AS rest, isfinite(l_quantity) AS finite, "
       "l_quantity BETWEEN 10 AND 20 AS inside, (l_tax > 0.04) <> (l_discount > 0.05) AS either FROM lineitem")
def fn_math(t):
    c = F.col
    ratio = fn.safe_divide(c("l_discount"), c("l_tax"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 1).alias("rounded"), F.round(F.abs(c("l_tax") - 0.04), 4).alias("gap"),
        F.round(F.ln("l_quantity"), 6).alias("ln"), F.round(F.exp("l_discount"), 6).alias("e"), F.round(F.pow("l_quantity", F.lit(2)), 4).alias("squared"),
        F.round(ratio, 6).alias("ratio"), fn.safe_mod(c("l_partkey"), (c("l_linenumber") - 1).cast("bigint")).alias("rest"),
        fn.is_finite(c("l_quantity")).alias("finite"), c("l_quantity").between(10, 20).alias("inside"),
        fn.xor(c("l_tax") > 0.04, c("l_discount") > 0.05).alias("either"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, "
       "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, c_nationkey IN (1, 2, 3) AS chosen, nullif(c_nationkey, 4) IS NULL AS missing FROM customer")
def fn_conditional(t):
    return t.customer.selectExpr(
        "c_custkey", "case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'rich' end as class",
        "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment", "c_nationkey in (1, 2, 3) as chosen", "nullif(c_nationkey, 4) is null as missing")


@query("SELECT doc_id, list_extract(w, 1) AS first_word, list_extract(w, -1) AS last_word, CAST(len(w) AS INTEGER) AS words, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_words, "
       "array_to_string(list_filter(w, lambda x: len(x) > 12), ' ') AS long_words, array_to_string(w[1:3], ' ') AS head, array_to_string(w[-2:], ' ') AS tail "
       "FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def fn_list(t):
    w = F.col("w")
    src = t.documents.select("doc_id", fn.split_literal("text", " ").alias("w"))
    return src.select(
        "doc_id", fn.list_get(w, 0).alias("first_word"), fn.list_get(w, -1).alias("last_word"), F.size(w).alias("words"),
        F.size(fn.distinct_values(w)).alias("distinct_words"), F.array_join(fn.where_values(w, lambda x: F.char_length(x) > 12), " ").alias("long_words"),
        F.array_join(fn.first_n(w, 3), " ").alias("head"), F.array_join(fn.last_n(w, 2), " ").alias("tail"))


@query("SELECT o_orderpriority, round(quantile_disc(o_totalprice, 0.9), 4) AS nearest, round(quantile_cont(o_totalprice, 0.9), 4) AS linear, "
       "round(stddev_samp(o_totalprice), 4) AS std, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def fn_aggregates(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(fn.quantile_disc("o_totalprice", 0.9), 4).alias("nearest"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("linear"),
        F.round(F.stddev_samp("o_totalprice"), 4).alias("std"), F.count_distinct("o_custkey").alias("customers"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), "
       "n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) "
       "SELECT doc_id, CAST(count(*) AS INTEGER) AS words, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n = 1) AS once, "
       "string_agg(word || '=' || n, ' ' ORDER BY word) FILTER (n > 20) AS frequent FROM n GROUP BY doc_id")
def fn_list_counts(t):
    """Value counts within the array of each text's words."""
    # A test of the counts instead of the text would be worked out before them, a second time.
    src = t.documents.where("text is not null").select("doc_id", fn.value_counts_map(fn.split_literal("text", " ")).alias("v"))
    n = F.col("v")["count"]
    often = F.array_sort(F.transform(F.filter("v", lambda x: x["count"] > 20), lambda x: F.struct(x["value"], x["count"])))
    named = F.array_join(F.transform(often, lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), " ")
    return src.select("doc_id", F.size("v").alias("words"), F.array_max(n).alias("most"), F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                      F.size(F.filter(n, lambda x: x == 1)).cast("bigint").alias("once"), F.when(F.array_max(n) > 20, named).alias("frequent"))


@query("SELECT event_id, CAST(ts AS TIMESTAMP) AS stamp FROM events")
def fn_zone_dropped(t):
    """Wall-clock time without a zone."""
    return t.events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("stamp"))
