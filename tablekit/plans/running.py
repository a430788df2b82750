"""Running totals and exact quantiles that split hot groups over many tasks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .layout import ordering, quoted, range_layout, with_tie_break
from .sizing import groups_fit, rows_per_task

#: A pass of `column_quantiles` narrows each wanted rank to about four in so many of the values it looked at.
_NARROWING = 10_000
#: Columns in one aggregate, which bounds its generated code.
COLUMNS_AT_ONCE = 16


def _same_group(keys: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]


def _named(keys: Sequence[str]) -> list[Column]:
    return [F.col(quoted(k)) for k in keys]


def _local_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Running total inside each (partition, group); groups are bounded by the range partition size."""
    window = (Window.partitionBy("_part", *_named(keys)).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(value).over(window))


def _part_totals(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Per (group, partition) sum with the total before it; at most one row per partition and group."""
    sums = df.groupBy(*_named(keys), "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*_named(keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.sum("_sum").over(before))


def running_sum(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, out: str,
                descending: bool = False) -> DataFrame:
    """Running sum of ``value`` per group in ``order_by`` order; null cells stay null."""
    number = F.coalesce(F.col(quoted(value)), F.lit(0))
    if groups_fit(df, keys):
        window = (Window.partitionBy(*_named(keys)).orderBy(*ordering(order_by, descending))
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, F.when(F.col(quoted(value)).isNotNull(), F.sum(number).over(window)))
    tied, tie = with_tie_break(df)
    order = ordering(order_by, descending) + [F.col(t) for t in tie if t not in order_by]
    laid = range_layout(tied, keys, order)
    local = _local_totals(laid, keys, order, number, "_local")
    names = [f"_g{i}" for i in range(len(keys))]
    # A partition can continue at most one group of the one before it, so this table has at most
    # as many rows as there are partitions and is safe to broadcast.
    carried = (_part_totals(laid, keys, number).where(F.col("_before").isNotNull())
               .select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)],
                       F.col("_part").alias("_carry_part"), "_before"))
    on = _same_group(keys, names) + [F.col("_part") == F.col("_carry_part")]
    joined = local.join(F.broadcast(carried), on, "left")
    total = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))
    return (joined.withColumn(out, F.when(F.col(quoted(value)).isNotNull(), total))
            .select(*_named(df.columns), F.col(quoted(out))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group; ``points`` maps output names to fractions.

    Groups within the rows of a task use the built-in ``percentile``. Otherwise equal values are first counted (map-side
    combined), the distinct values are range-partitioned within their group, and only the partition
    holding a wanted rank is looked at, so neither a hot group nor a wide domain meets one task.
    """
    if groups_fit(df, keys):
        names, fractions = list(points), list(points.values())
        grouped = df.groupBy(*_named(keys)).agg(F.percentile(F.col(quoted(value)), F.array(*map(F.lit, fractions))).alias("_q"))
        return grouped.select(*_named(keys), *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    counted = (df.where(F.col(quoted(value)).isNotNull()).groupBy(*_named(keys), F.col(quoted(value)).alias("_v"))
               .agg(F.count("*").alias("_n")))
    laid = range_layout(counted, keys, [F.col("_v").asc()])
    local = _local_totals(laid, keys, [F.col("_v")], F.col("_n"), "_upto")
    every = Window.partitionBy(*_named(keys))
    parts = (_part_totals(laid, keys, F.col("_n")).fillna(0, ["_before"])
             .withColumn("_total", F.sum("_sum").over(every)))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(n).alias("point"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("at"))
        for n, q in points.items()]))
    ranks = parts.withColumn("_w", wanted).select(
        *_named(keys), "_part", "_before", F.col("_w.point").alias("_point"), F.col("_w.at").alias("_at"), "_sum",
        F.explode(F.array(F.floor("_w.at"), F.ceil("_w.at"))).alias("_rank")).distinct()
    ranks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_sum")))
    names = [f"_g{i}" for i in range(len(keys))]
    ranks = ranks.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col("_part").alias("_rank_part"),
                         (F.col("_rank") - F.col("_before")).alias("_local_rank"), "_rank", "_point", "_at")
    on = _same_group(keys, names) + [F.col("_part") == F.col("_rank_part")]
    hits = (local.join(ranks, on)
            .where((F.col("_local_rank") < F.col("_upto")) & (F.col("_local_rank") >= F.col("_upto") - F.col("_n"))))
    low, high = F.min("_v").cast("double"), F.max("_v").cast("double")
    share = F.max(F.col("_at") - F.floor("_at"))
    picked = hits.groupBy(*_named(keys), "_point").agg((low + (high - low) * share).alias("_q"))
    wide = picked.groupBy(*_named(keys)).agg(*[F.max(F.when(F.col("_point") == n, F.col("_q"))).alias(n) for n in points])
    groups = df.groupBy(*_named(keys)).agg(F.count("*").alias("_rows")).drop("_rows") if keys else None
    if groups is None:
        return wide
    renamed = wide.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], *points)
    return groups.join(renamed, _same_group(keys, names), "left").select(*_named(keys), *points)


def column_quantiles(df: DataFrame, columns: Mapping[str, Column], points: Mapping[str, float], few: int | None = None) -> dict[str, dict[str, float | None]]:
    """Exact linear-interpolated quantiles of whole columns, by passes that narrow and move no rows.

    Every wanted rank has an interval of values that holds it, with the number of values below and inside. A pass looks at the
    values inside alone: quantile sketches, which combine on the map side, propose tighter bounds, and the next pass counts exactly what is below
    and inside them; bounds that miss a rank cost a pass, not the result. An interval of one value, or of at most `few` values (an eighth of
    ``tablekit.rowsPerTask``, unless given), which one aggregate then sorts, ends the search. The work is some passes over the
    columns: four for 10^13 rows. The driver holds a few numbers per column and point. Nulls and NaN are left out of account; a column without
    values has null quantiles.
    """
    few = few or max(16, rows_per_task(df.sparkSession) // 8)
    names, found = list(columns), {c: dict.fromkeys(points) for c in columns}
    value = {c: F.when(~F.isnan(columns[c].cast("double")), columns[c].cast("double")) for c in names}
    wanted = {}
    for some in (names[i:i + COLUMNS_AT_ONCE] for i in range(0, len(names), COLUMNS_AT_ONCE)):
        facts = df.agg(*[agg(value[c]).alias(f"{k}{i}") for i, c in enumerate(some) for k, agg in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(some):
            for point, share in points.items():
                if facts[f"n{i}"]:
                    at = float(share) * (facts[f"n{i}"] - 1)
                    for rank in {math.floor(at), math.ceil(at)}:
                        wanted[c, rank] = (facts[f"lo{i}"], facts[f"hi{i}"], 0, facts[f"n{i}"])
    counts = {c: n for (c, _), (_, _, _, n) in wanted.items()}
    ranks: dict[tuple[str, int], float] = {}
    while wanted:
        for key, (lo, hi, below, inside) in wanted.items():
            if lo == hi:
                ranks[key] = lo
        wanted = {key: state for key, state in wanted.items() if key not in ranks}
        keys = list(wanted)
        for some in (keys[i:i + COLUMNS_AT_ONCE] for i in range(0, len(keys), COLUMNS_AT_ONCE)):
            _narrow(df, value, wanted, ranks, some, few)
        wanted = {key: state for key, state in wanted.items() if key not in ranks}
    for c, n in counts.items():
        for point, share in points.items():
            at = float(share) * (n - 1)
            low, high = ranks[c, math.floor(at)], ranks[c, math.ceil(at)]
            found[c][point] = low if low == high else low + (high - low) * (at - math.floor(at))
    return found


def _narrow(df: DataFrame, value: Mapping[str, Column], wanted: dict, ranks: dict, some: Sequence[tuple[str, int]], few: int) -> None:
    """One round of `column_quantiles` for some of the wanted ranks: settles them in `ranks` or tightens their intervals in `wanted`."""
    inside = {key: F.when(value[key[0]].between(*wanted[key][:2]), value[key[0]]) for key in some}
    proposals = []
    for key in some:
        _, _, below, n = wanted[key]
        if n <= few:
            proposals.append(F.get(F.array_sort(F.collect_list(inside[key])), F.lit(key[1] - below)))
        else:
            at, slack = (key[1] - below) / (n - 1), 2.0 / _NARROWING
            proposals.append(F.percentile_approx(inside[key], [max(0.0, at - slack), min(1.0, at + slack)], _NARROWING))
    got = df.agg(*[p.alias(f"v{i}") for i, p in enumerate(proposals)]).first()
    ranks.update({key: got[i] for i, key in enumerate(some) if wanted[key][3] <= few})
    open_ = {key: got[i] for i, key in enumerate(some) if key not in ranks}
    if not open_:
        return
    checks = []
    for i, (key, (a, b)) in enumerate(open_.items()):
        v = inside[key]
        checks += [F.count_if(v < a).alias(f"under{i}"), F.count_if(v <= a).alias(f"upto_a{i}"), F.count_if(v <= b).alias(f"upto_b{i}"),
                   F.max(F.when(v < a, v)).alias(f"before_a{i}"), F.min(F.when(v > a, v)).alias(f"past_a{i}"), F.min(F.when(v > b, v)).alias(f"past_b{i}")]
    row = df.agg(*checks).first()
    for i, (key, (a, b)) in enumerate(open_.items()):
        lo, hi, below, n = wanted[key]
        under, upto_a, upto_b = row[f"under{i}"], row[f"upto_a{i}"], row[f"upto_b{i}"]
        rank = key[1] - below
        if rank < under:
            wanted[key] = (lo, row[f"before_a{i}"], below, under)
        elif rank < upto_a:
            ranks[key] = a
        elif rank < upto_b:
            wanted[key] = (row[f"past_a{i}"], b, below + upto_a, upto_b - upto_a)
        else:
            wanted[key] = (row[f"past_b{i}"], hi, below + upto_b, n - upto_b)
