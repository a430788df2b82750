"""The tables behind the charts. Aggregating charts run on all rows; point charts on whatever rows are passed in.

Series (colour, symbol, pattern) and facets are extra group keys, never one scan per category. Column
names of the result describe the chart: ``x``, ``y``, ``value``, ``bin`` and so on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numeric import lenient_double
from ..plans.layout import durable, quoted, sorted_by
from ..plans.running import exact_quantiles, running_sum
from ..plans.skew import join_groups
from .aggregate import group_summary
from .columns import display_column, marker_size
from .convert import category_codes
from .windows import aggregate_over

DEFAULT_BINS = 10
KDE_GRID = 500
# Values are summed by cells of a quarter bandwidth, as power sums up to this order around the cell's centre. By Cramer's bound on
# Hermite functions, what is left out of a kernel (1 at its peak) is below 1.1 * (1/8)^10 / sqrt(10!), that is 6e-13.
_CELLS_PER_BAND, _ORDER = 4, 10
# Bandwidths beyond which a kernel is 0 in double precision next to 1: exp(-8.5^2 / 2) is 2e-16.
_REACH = 8.5
# Bins that are written by one row at a time.
_BIN_RUN = 4096
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NORMS = (None, "percent", "probability", "density", "probability density")


def plain_number(df: DataFrame, column: str) -> Column:
    """A numeric or temporal column as a double; times count days since 1970."""
    dtype, col = df.schema[column].dataType, F.col(quoted(column))
    if isinstance(dtype, _TIMES):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"),
                                col.cast("timestamp_ntz")) / 86_400_000_000.0
    return lenient_double(col, dtype)


def _keys(*columns: str | None) -> list[str]:
    return list(dict.fromkeys(c for c in columns if c))


def _categorical(df: DataFrame, column: str | None) -> str | None:
    """The column when it splits series (text or boolean), else None."""
    return column if column and isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType)) else None


def drop_null_keys(df: DataFrame, *columns: str | None) -> DataFrame:
    for c in _keys(*columns):
        df = df.where(F.col(quoted(c)).isNotNull())
    return df


# -- points: scatter, line, strip ---------------------------------------------

def points_table(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
                 symbol: str | None = None, hover: Sequence[str] = (), facet_row: str | None = None,
                 facet_col: str | None = None, sort_x: bool = False) -> DataFrame:
    """Rows of a scatter, line (``sort_x``) or strip chart: axes, colour, size, symbol, hover text, facets."""
    src = drop_null_keys(marker_size(df, size, "_size") if size else df, facet_row, facet_col)
    named = {"x": x, "y": y, "color": color, "symbol": symbol, "facet_row": facet_row, "facet_col": facet_col}
    cols = [F.col(quoted(c)).alias(n) for n, c in named.items() if c]
    if size:
        cols.append(F.col("_size").alias("size"))
    cols += [display_column(F.col(quoted(c)), df.schema[c].dataType).alias(f"hover_{c}") for c in hover]
    out = src.select(*cols)
    return sorted_by(out, [F.col("x").asc_nulls_first()]) if sort_x else out


def series_table(df: DataFrame, color: str | None = None, symbol: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """Add ``series`` and ``series_index`` (position of the category in sorted order, for the palette); crossed
    series also get ``pattern_index``.

    The series is the categorical colour, else the symbol, else the pattern; colour and pattern
    together make cross series named ``colour (pattern)``. Rows with a null series are dropped.
    """
    color, symbol, pattern = (_categorical(df, c) for c in (color, symbol, pattern))
    main = color or symbol or pattern
    if main is None:
        return df.withColumns({"series": F.lit(None).cast("string"), "series_index": F.lit(0).cast("bigint")})
    crossed = color is not None and pattern not in (None, color)
    kept = drop_null_keys(df, main, pattern if crossed else None)
    name = F.col(quoted(main)).cast("string")
    if crossed:
        name = F.concat(name, F.lit(" ("), F.col(quoted(pattern)).cast("string"), F.lit(")"))
    out = category_codes(kept.withColumn("series", name), main, "series_index")
    return category_codes(out, pattern, "pattern_index") if crossed else out


# -- bars and pies -------------------------------------------------------------

def bar_table(df: DataFrame, x: str, y: str | None = None, func: str = "sum", color: str | None = None,
              pattern: str | None = None, mode: str = "group", hover: Sequence[str] = (), order_by="_row_id",
              facet_row: str | None = None, facet_col: str | None = None) -> DataFrame:
    """Aggregated bars keyed by x and the categorical colour and pattern; ``relative`` adds shares per x."""
    src = drop_null_keys(df, facet_row, facet_col)
    keys = _keys(x, _categorical(df, color), _categorical(df, pattern), facet_row, facet_col)
    carry = [c for c in hover if c not in keys and c != y]
    out = group_summary(src, keys, func, y, carry, order_by)
    if mode != "relative":
        return out
    within = _keys(x, facet_row, facet_col)
    shared = aggregate_over(out, within, {"_total": F.sum("value")})
    return shared.withColumn("share", F.try_divide(F.col("value").cast("double"), F.col("_total"))).drop("_total")


def pie_table(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """Rows, or a leniently summed column, per category with the percentage of the whole."""
    slices = group_summary(df, [names], "sum" if values else "count", values)
    number = lenient_double(F.col(quoted(values)), df.schema[values].dataType) if values else None
    total = df.agg((F.sum(number) if values else F.count("*")).cast("double").alias("t")).scalar()
    return slices.withColumn("percent", F.try_divide(F.col("value") * 100.0, total))


# -- histograms -----------------------------------------------------------------

def _range(df: DataFrame, value: Column) -> Column:
    """Struct ``lo, hi, n`` of a column as a scalar subquery."""
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).alias("r")).scalar()


def _bin_of(value: Column, low: Column, width: Column, bins: Column) -> Column:
    """Equal-width bin number; the maximum belongs to the last bin."""
    place = F.floor((value - low) / width)
    return F.least(F.greatest(place, F.lit(0)), bins - 1).cast("int")


def histogram_table(df: DataFrame, x: str, bins: int = DEFAULT_BINS, weight: str | None = None,
                    color: str | None = None, norm: str | None = None, cumulative: bool = False,
                    facet_row: str | None = None, facet_col: str | None = None) -> DataFrame:
    """Counts or weight sums per equal-width bin over the column's range, empty bins included.

    ``bins=0`` takes ceil(log2(rows)) + 1 bins. Norms are per series: percent, probability, density,
    probability density. Rows are reduced to (series, bin) before the shuffle; all bins of a series are then generated and joined to those with rows,
    so any number of bins will do.
    """
    if norm not in _NORMS:
        raise ValueError(f"unknown norm {norm!r}")
    if bins < 0:
        raise ValueError("bins must not be negative")
    series = _keys(_categorical(df, color), facet_row, facet_col)
    named = [F.col(quoted(s)) for s in series]
    src = drop_null_keys(df, *series)
    value = plain_number(src, x)
    limits = _range(src, value)
    n_bins = F.lit(bins) if bins else (F.ceil(F.log2(F.greatest(limits["n"], F.lit(1)))) + 1).cast("int")
    span = F.when(limits["hi"] > limits["lo"], limits["hi"] - limits["lo"]).otherwise(F.lit(1.0))
    amount = F.sum(lenient_double(F.col(quoted(weight)), df.schema[weight].dataType)) if weight else \
        F.count("*").cast("double")
    filled = (src.where(value.isNotNull())
              .withColumns({"_lo": limits["lo"], "_width": span / n_bins, "_bins": n_bins})
              .withColumn("bin", _bin_of(value, F.col("_lo"), F.col("_width"), F.col("_bins")))
              .groupBy(*named, "bin", "_lo", "_width", "_bins").agg(amount.alias("_v")))
    totals = filled.groupBy(*named, "_lo", "_width", "_bins").agg(F.sum("_v").alias("_total"))
    runs = totals.withColumn("_run", F.explode(F.expr(f"sequence(0, (_bins - 1) div {_BIN_RUN})")))
    every = runs.withColumn("bin", F.explode(F.expr(f"sequence(cast(_run * {_BIN_RUN} as int), cast(least(_run * {_BIN_RUN} + {_BIN_RUN}, _bins) - 1 as int))")))
    out = every.join(filled.drop("_lo", "_width", "_bins"), [*series, "bin"], "left")
    raw = F.coalesce(F.col("_v"), F.lit(0.0))
    scaled = {None: raw, "percent": F.try_divide(raw * 100.0, F.col("_total")),
              "probability": F.try_divide(raw, F.col("_total")), "density": raw / F.col("_width"),
              "probability density": F.try_divide(raw, F.col("_total") * F.col("_width"))}[norm]
    out = out.select(*named, "bin", (F.col("_lo") + F.col("bin") * F.col("_width")).alias("lo"),
                     (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("hi"), scaled.alias("value"))
    return running_sum(out, series, ["bin"], "value", "value") if cumulative else out


def density_table(df: DataFrame, x: str, y: str, x_bins: int = 20, y_bins: int = 20,
                  weight: str | None = None) -> DataFrame:
    """Counts or weight sums on an x-by-y grid, non-empty cells only."""
    vx, vy = plain_number(df, x), plain_number(df, y)
    both = df.where(vx.isNotNull() & vy.isNotNull())
    limits = both.agg(F.struct(F.min(vx).alias("x0"), F.max(vx).alias("x1"), F.min(vy).alias("y0"),
                               F.max(vy).alias("y1")).alias("r")).scalar()

    def place(value, low, high, bins):
        span = F.when(limits[high] > limits[low], limits[high] - limits[low]).otherwise(F.lit(1.0))
        return _bin_of(value, limits[low], span / bins, F.lit(bins))

    amount = F.sum(lenient_double(F.col(quoted(weight)), df.schema[weight].dataType)) if weight else F.count("*")
    return (both.select(place(vx, "x0", "x1", x_bins).alias("x_bin"), place(vy, "y0", "y1", y_bins).alias("y_bin"), "*")
            .groupBy("x_bin", "y_bin").agg(amount.alias("value")))


def density_marginals(df: DataFrame, x: str, y: str, x_bins: int = 20, y_bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """The histograms along both axes of a density table."""
    return histogram_table(df, x, x_bins), histogram_table(df, y, y_bins)


# -- boxes and violins -------------------------------------------------------------

def box_table(df: DataFrame, y: str, x: str | None = None, color: str | None = None, split: str | None = None,
              facet_row: str | None = None, facet_col: str | None = None) -> DataFrame:
    """Five-number summary, fences, whiskers and outlier count per group."""
    keys = _keys(x, _categorical(df, color), split, facet_row, facet_col)
    narrow = _grouped_values(df, y, keys)
    fenced = _fences(narrow, keys)
    spans = (_with_fences(narrow, fenced, keys).groupBy(*[F.col(quoted(k)) for k in keys]).agg(
        F.count("*").alias("count"), F.min("_y").alias("min"), F.max("_y").alias("max"),
        F.min(F.when(F.col("_y") >= F.col("lower_fence"), F.col("_y"))).alias("lower_whisker"),
        F.max(F.when(F.col("_y") <= F.col("upper_fence"), F.col("_y"))).alias("upper_whisker"),
        F.count_if((F.col("_y") < F.col("lower_fence")) | (F.col("_y") > F.col("upper_fence"))).alias("outliers")))
    joined = _with_fences(spans, fenced, keys)
    return joined.select(*[F.col(quoted(k)) for k in keys], "count", "min", "q1", "median", "q3", "max", "lower_fence",
                         "upper_fence", "lower_whisker", "upper_whisker", "outliers")


def box_outliers(df: DataFrame, y: str, x: str | None = None, color: str | None = None) -> DataFrame:
    """Values outside their group's fences."""
    keys = _keys(x, _categorical(df, color))
    narrow = _grouped_values(df, y, keys)
    out = _with_fences(narrow, _fences(narrow, keys), keys)
    return (out.where((F.col("_y") < F.col("lower_fence")) | (F.col("_y") > F.col("upper_fence")))
            .select(*[F.col(quoted(k)) for k in keys], F.col("_y").alias("value")))


def _grouped_values(df: DataFrame, y: str, keys: Sequence[str]) -> DataFrame:
    value = plain_number(df, y)
    return df.select(*[F.col(quoted(k)) for k in keys], value.alias("_y")).where(F.col("_y").isNotNull())


def _fences(narrow: DataFrame, keys: Sequence[str]) -> DataFrame:
    quarts = exact_quantiles(narrow, keys, "_y", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = quarts.withColumns({"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach})
    return durable(fenced) if keys else fenced


def _with_fences(df: DataFrame, fenced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the group's fences to its rows; without keys they are one row, read as a scalar."""
    stats = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    if not keys:
        one = fenced.select(F.struct(*stats)).scalar()
        return df.withColumns({s: one[s] for s in stats})
    names = [f"_b{i}" for i in range(len(keys))]
    side = fenced.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], *stats)
    return join_groups(df, side, keys, names).drop(*names)


def violin_table(df: DataFrame, y: str, x: str | None = None, color: str | None = None,
                 split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Box summary and density curve per group; a two-valued ``split`` column is one more key."""
    keys = _keys(x, _categorical(df, color), split)
    return box_table(df, y, x, color, split), kde_curve(df, y, keys)


# -- distributions ---------------------------------------------------------------------

def _melted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, v)`` pairs without nulls; temporal columns become days since the earliest value of all."""
    temporal = [isinstance(df.schema[c].dataType, _TIMES) for c in columns]
    if any(temporal) and not all(temporal):
        raise ValueError("columns must be all numeric or all temporal")
    values = {c: plain_number(df, c) for c in columns}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("v")) for c, v in values.items()]))
    long = df.select(cells.alias("c")).select("c.column", "c.v").where(F.col("v").isNotNull())
    return days_since_start(long, df, values) if any(temporal) else long


def days_since_start(long: DataFrame, df: DataFrame, values: dict[str, Column]) -> DataFrame:
    lows = [F.min(v) for v in values.values()]
    start = df.agg((F.least(*lows) if len(lows) > 1 else lows[0]).alias("s")).scalar()
    return long.withColumn("v", F.col("v") - start)


def distribution_histogram(df: DataFrame, columns: Sequence[str], bin_count: int | None = None,
                           bin_width: float | Sequence[float] | None = None) -> DataFrame:
    """Probability density per bin for several columns: by bin count, by width, by a width per column, or range/10."""
    long = _melted(df, columns)
    stats = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    if bin_width is None:
        wide = F.when((F.col("n") > 1) & (F.col("hi") > F.col("lo")),
                      (F.col("hi") - F.col("lo")) / (bin_count or DEFAULT_BINS)).otherwise(F.lit(0.01))
    else:
        widths = [float(bin_width)] * len(columns) if isinstance(bin_width, (int, float)) else list(bin_width)
        widths = widths * len(columns) if len(widths) == 1 else widths
        wide = F.lit(None).cast("double")
        for c, w in zip(columns, widths, strict=True):
            wide = F.when(F.col("column") == c, F.lit(float(w))).otherwise(wide)
    stats = stats.withColumn("width", wide).withColumnRenamed("column", "_column")
    # One row per column: its size is the number of columns asked for.
    joined = long.join(F.broadcast(stats), F.col("column") == F.col("_column"))
    place = F.floor((F.col("v") - F.col("lo")) / F.col("width"))
    last = F.ceil((F.col("hi") - F.col("lo")) / F.col("width")) - 1
    return (joined.select("column", "lo", "width", "n", F.least(place, F.greatest(last, F.lit(0))).alias("bin"))
            .groupBy("column", "bin", "lo", "width", "n").agg(F.count("*").alias("count"))
            .select("column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "width", "count",
                    (F.col("count") / (F.col("n") * F.col("width"))).alias("density")))


def _grid(stats: DataFrame, points: int) -> DataFrame:
    step = (F.col("hi") - F.col("lo")) / points
    return (stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", F.col("lo") + F.col("point") * step))


def normal_curve(df: DataFrame, columns: Sequence[str], points: int = KDE_GRID) -> DataFrame:
    """Normal density with each column's mean and deviation on an even grid over its range."""
    stats = _melted(df, columns).groupBy("column").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    z = F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))
    pdf = F.try_divide(F.exp(-z * z / 2), F.col("sd") * F.sqrt(F.lit(2.0) * F.pi()))
    return _grid(stats, points).select("column", "point", "x", pdf.alias("density"))


def kde_curve(df: DataFrame, y: str, keys: Sequence[str] = (), points: int = KDE_GRID) -> DataFrame:
    """Gaussian density of a column per group, bandwidth ``sd * n^(-1/5)``.

    The sum over all values, to within 6e-13 of each value's own kernel: values meet the grid points within `_REACH` bandwidths only, and are
    first reduced to power sums by cells of a quarter bandwidth, whose number does not depend on that of the grid points.
    """
    return _kde(_grouped_values(df, y, keys).withColumnRenamed("_y", "v"), list(keys), points)


def distribution_kde(df: DataFrame, columns: Sequence[str], points: int = KDE_GRID) -> DataFrame:
    return _kde(_melted(df, columns), ["column"], points)


def _kde(long: DataFrame, keys: list[str], points: int) -> DataFrame:
    names = [f"_d{i}" for i in range(len(keys))]
    group = [F.col(quoted(k)) for k in keys]
    stats = long.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"),
                                     (F.stddev_samp("v") * F.pow(F.count("*"), F.lit(-0.2))).alias("band"))
    told = ("lo", "hi", "n", "band")
    if keys:
        stats = durable(stats)
        side = stats.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], *told)
        rows = join_groups(long, side, keys, names).drop(*names)
    else:
        one = stats.select(F.struct(*told)).scalar()
        rows = long.withColumns({s: one[s] for s in told})
    # exp(-(t - u)^2 / 2) is exp(-t^2 / 2) times the sum of He_j(t) u^j / j!, with t from the cell's centre and u within it.
    cell = F.floor((F.col("v") - F.col("lo")) / F.col("band") * _CELLS_PER_BAND)
    rows = rows.where("band > 0").withColumn("_cell", cell).withColumn("_u", (F.col("v") - F.col("lo")) / F.col("band") - (F.col("_cell") + 0.5) / _CELLS_PER_BAND)
    powers = [F.lit(1.0)]
    for _ in range(_ORDER - 1):
        powers.append(powers[-1] * F.col("_u"))
    cells = rows.groupBy(*group, "lo", "hi", "n", "band", "_cell").agg(*[F.sum(u).alias(f"_m{j}") for j, u in enumerate(powers)])
    step = (F.col("hi") - F.col("lo")) / points
    center = (F.col("_cell") + 0.5) / _CELLS_PER_BAND * F.col("band")
    first = F.greatest(F.ceil((center - F.col("band") * _REACH) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((center + F.col("band") * _REACH) / step), F.lit(points - 1)).cast("int")
    met = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last))).withColumn("_t", (F.col("point") * step - center) / F.col("band"))
    hermite, total = [F.lit(1.0), F.col("_t")], F.lit(0.0)
    for j in range(2, _ORDER):
        hermite.append(F.col("_t") * hermite[j - 1] - (j - 1) * hermite[j - 2])
    for j in range(_ORDER):
        total = total + hermite[j] * F.col(f"_m{j}") / math.factorial(j)
    pulls = met.select(*group, "point", (F.exp(-F.col("_t") * F.col("_t") / 2) * total).alias("_pull"))
    grid = _grid(stats, points)
    empty = grid.select(*group, "point", "x", F.when(F.col("band") > 0, F.col("band") * F.col("n") * math.sqrt(2 * math.pi)).alias("_scale"), F.lit(0.0).alias("_pull"))
    both = empty.unionByName(pulls, allowMissingColumns=True)
    return both.groupBy(*group, "point").agg(F.max("x").alias("x"), F.try_divide(F.sum("_pull"), F.max("_scale")).alias("density"))


def rug_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The single values under a distribution chart."""
    return _melted(df, columns).select("column", F.col("v").alias("value"))
