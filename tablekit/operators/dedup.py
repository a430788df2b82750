"""Row de-duplication over all columns or a subset, keeping the first, last or no copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.layout import ROW_ID, quoted
from .occurrence import first_occurrence, only_unique


def drop_duplicate_rows(df: DataFrame, keep: str = "first", subset: Sequence[str] | None = None,
                        order_by: str | Sequence[str] | None = None) -> DataFrame:
    """Drop repeated rows; ``keep`` is first, last or none. The order columns never count as content.

    Over all columns the key is the row itself, so a hash aggregate with map-side combine does the
    whole job: copies collapse before the shuffle however many there are.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep must be first, last or none, not {keep!r}")
    order = [order_by] if isinstance(order_by, str) else list(order_by or ([ROW_ID] if ROW_ID in df.columns else []))
    content = [c for c in df.columns if c not in order]
    if subset is None or set(subset) == set(content):
        keys = [F.col(quoted(c)) for c in content]
        if not order:
            if keep != "none":
                return df.distinct()
            return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
        spot = F.struct(*[F.col(quoted(c)) for c in order]) if len(order) > 1 else F.col(quoted(order[0]))
        pick = F.max(spot) if keep == "last" else F.min(spot)
        rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), pick.alias("_spot"))
        if keep == "none":
            rows = rows.where("_n = 1")
        back = [F.col("_spot")[c].alias(c) for c in order] if len(order) > 1 else [F.col("_spot").alias(order[0])]
        return rows.select(*keys, *back).select(*[F.col(quoted(c)) for c in df.columns])
    if keep == "none":
        return only_unique(df, subset)
    if not order:
        return df.dropDuplicates(list(subset))
    return first_occurrence(df, subset, order, last=keep == "last")
