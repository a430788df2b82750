"""Stacking, side-by-side and key-aligned concatenation of two tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numeric import INTEGRAL_TYPES
from ..plans.layout import ROW_ID, quoted, sorted_by, with_row_id
from ..plans.skew import equi_join


def stack_strict(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Vertical: names, order and types must agree."""
    shape = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    if shape(top) != shape(bottom):
        raise ValueError("tables differ in column names, order or types")
    return top.union(bottom)


_WIDTH = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3, T.FloatType: 4, T.DoubleType: 5}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type both columns fit in; text wins over everything else, so no value can fail to convert."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in _WIDTH and type(b) in _WIDTH:
        wide, thin = (a, b) if _WIDTH[type(a)] >= _WIDTH[type(b)] else (b, a)
        # A float cannot hold every int or bigint.
        return T.DoubleType() if isinstance(wide, T.FloatType) and isinstance(thin, (T.IntegerType, T.LongType)) else wide
    if isinstance(a, T.DecimalType) and isinstance(b, (T.FloatType, T.DoubleType)) or \
            isinstance(b, T.DecimalType) and isinstance(a, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    for dec, num in ((a, b), (b, a)):
        if isinstance(dec, T.DecimalType) and isinstance(num, INTEGRAL_TYPES):
            return T.DecimalType(min(38, max(dec.precision - dec.scale, 20) + dec.scale), dec.scale)
    days = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, days) and isinstance(b, days):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def stack_relaxed(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Vertical by name: missing columns are null, differing types meet in a common one."""
    types = {f.name: f.dataType for f in bottom.schema.fields}
    wanted = {f.name: common_type(f.dataType, types[f.name]) for f in top.schema.fields if f.name in types}

    def fit(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(quoted(f.name)).cast(wanted[f.name]).alias(f.name)
                           if f.name in wanted and wanted[f.name] != f.dataType else F.col(quoted(f.name))
                           for f in df.schema.fields])

    return fit(top).unionByName(fit(bottom), allowMissingColumns=True)


def stack_common(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Vertical over the shared columns only, in the order of the first table."""
    shared = [c for c in top.columns if c in bottom.columns]
    if not shared:
        raise ValueError("no common columns")
    pick = [F.col(quoted(c)) for c in shared]
    return stack_strict(top.select(*pick), bottom.select(*pick))


def stack_diagonal(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Union of the columns with null fill and common types."""
    return stack_relaxed(top, bottom)


@dataclass(frozen=True)
class ColumnMap:
    """One row of a side-by-side mapping: keep ``current``?, pair it with ``other``, name the output."""

    current: str
    other: str | None = None
    include_current: bool = True
    output: str | None = None


def normalized(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def name_score(a: str, b: str) -> int:
    """Likeness of two names, 0 to 100, whatever the order of their words."""
    spread = lambda s: " ".join(sorted(re.sub(r"[^a-z0-9]+", " ", str(s).lower()).split()))
    return round(100 * SequenceMatcher(None, spread(a), spread(b)).ratio())


def match_names(reference: Sequence[str], target: Sequence[str], threshold: int = 75,
                keep_unmatched: bool = True) -> dict[str, str | None]:
    """One-to-one matching of column names: equal normalised names first, then the most alike, first come first served.

    Works on schemas, not on data: its cost depends on the number of columns alone.
    """
    free = {normalized(c): c for c in target}
    last = {normalized(c): c for c in reference}
    found: dict[str, str | None] = {c: free.pop(n) for n, c in last.items() if n in free}
    for name in reference:
        if name in found:
            continue
        best = max(free.values(), key=lambda c: name_score(name, c), default=None)
        found[name] = best if best is not None and name_score(name, best) >= threshold else None
        if found[name] is not None:
            del free[normalized(best)]
    return {c: found[c] for c in reference if keep_unmatched or found[c] is not None}


def default_mapping(left: Sequence[str], right: Sequence[str]) -> list[ColumnMap]:
    """Pair every left column with the right column of the most alike name, if any."""
    return [ColumnMap(mine, theirs) for mine, theirs in match_names(left, right).items()]


def rename_like(df: DataFrame, reference: DataFrame, threshold: int = 75) -> DataFrame:
    """Rename the columns of a table to the most alike names of a reference table."""
    pairs = match_names(reference.columns, df.columns, threshold, keep_unmatched=False)
    return df.withColumnsRenamed({theirs: ours for ours, theirs in pairs.items()})


def beside(left: DataFrame, right: DataFrame, mapping: Sequence[ColumnMap] | None = None,
           left_order: str | Sequence[str] | None = None, right_order: str | Sequence[str] | None = None,
           suffix: str = "_right") -> DataFrame:
    """Side by side by row position, the shorter table padded with nulls; result carries ``_row_id``.

    Rows are numbered consecutively (existing row ids are used as they are) and joined on the number, which is
    unique, so the join cannot skew. With a ``mapping`` only mapped columns are taken from the right.
    """
    numbered = [df if ROW_ID in df.columns and order is None else with_row_id(df, order)
                for df, order in ((left, left_order), (right, right_order))]
    if mapping is None:
        lefts = [(c, c) for c in left.columns if c != ROW_ID]
        rights = [(c, c) for c in right.columns if c != ROW_ID]
    else:
        lefts = [(m.current, m.output or m.current) for m in mapping if m.include_current]
        rights = [(m.other, m.output or m.current) for m in mapping if m.other]
    taken, named = {n.lower() for _, n in lefts}, []
    for source, name in rights:
        while name.lower() in taken:
            name += suffix
        taken.add(name.lower())
        named.append((source, name))
    lhs = numbered[0].select(F.col(ROW_ID).alias("_l"), *[F.col(quoted(c)).alias(n) for c, n in lefts])
    rhs = numbered[1].select(F.col(ROW_ID).alias("_r"), *[F.col(quoted(c)).alias(n) for c, n in named])
    joined = lhs.join(rhs, F.col("_l") == F.col("_r"), "full")
    return joined.select(F.coalesce("_l", "_r").alias(ROW_ID), *[F.col(quoted(n)) for _, n in lefts + named])


def align(left: DataFrame, right: DataFrame, how: str = "full", keys: Sequence[str] | None = None,
          suffix: str = "_right", ordered: bool = True) -> DataFrame:
    """Line two tables up by key: full, inner, left or right; keys are folded together, rows sorted by them.

    Keys default to the first column of the left table.
    """
    if how not in ("full", "inner", "left", "right"):
        raise ValueError(f"unknown alignment {how!r}")
    keys = list(keys or left.columns[:1])
    absent = [k for k in keys if k not in left.columns or k not in right.columns]
    if absent:
        raise ValueError(f"key columns missing from a side: {absent}")
    taken, names = {c.lower() for c in left.columns}, {}
    for c in right.columns:
        if c not in keys:
            name = c
            while name.lower() in taken:
                name += suffix
            taken.add(name.lower())
            names[c] = name
    aliases = [f"_key{i}" for i in range(len(keys))]
    side = right.select(*[F.col(quoted(k)).alias(a) for k, a in zip(keys, aliases)],
                        *[F.col(quoted(c)).alias(n) for c, n in names.items()])
    joined = equi_join(left, side, keys, aliases, how)
    folded = [F.coalesce(F.col(quoted(k)), F.col(a)).alias(k) for k, a in zip(keys, aliases)]
    rest = [F.col(quoted(c)) for c in left.columns if c not in keys]
    out = joined.select(*folded, *rest, *[F.col(quoted(n)) for n in names.values()])
    return sorted_by(out, [F.col(quoted(k)).asc_nulls_first() for k in keys]) if ordered else out


STACKS: Mapping[str, object] = {"vertical": stack_strict, "vertical_relaxed": stack_relaxed,
                                "vertical_common": stack_common, "diagonal_relaxed": stack_diagonal}


def concat_tables(left: DataFrame, right: DataFrame, how: str = "vertical_relaxed", partitions: int | None = None,
                  **options) -> DataFrame:
    """Concatenate by mode name; ``partitions`` asks for fewer, larger output partitions."""
    if how in STACKS:
        out = STACKS[how](left, right)
    elif how == "horizontal":
        out = beside(left, right, **options)
    elif how == "align" or how.startswith("align_"):
        out = align(left, right, how.partition("_")[2] or "full", **options)
    else:
        raise ValueError(f"unknown concatenation {how!r}")
    return out.coalesce(partitions) if partitions else out
