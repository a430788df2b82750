"""Equi, semi, anti and cross joins of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.layout import quoted
from ..plans.skew import equi_join

_HOW = {"inner": "inner", "left": "left", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti",
        "cross": "cross"}


def _free_name(name: str, suffix: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += suffix
    return name


def join_tables(left: DataFrame, right: DataFrame, left_on: str | Sequence[str] = (),
                right_on: str | Sequence[str] | None = None, how: str = "inner", suffix: str = "_other",
                coalesce_keys: bool = False) -> DataFrame:
    """Join on one or more key pairs. Null keys never match; right columns that collide get ``suffix``.

    Inner and left joins drop the right keys. Outer joins keep both (the right one suffixed on a name
    clash) unless ``coalesce_keys`` folds them into the left name.
    """
    if how not in _HOW:
        raise ValueError(f"unknown join type {how!r}")
    kind = _HOW[how]
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = left_on if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    if kind != "cross" and (not left_on or len(left_on) != len(right_on)):
        raise ValueError("a join needs at least one key pair")
    taken = {c.lower() for c in left.columns}
    if kind == "cross":
        renamed = right.toDF(*[_free_name(c, suffix, taken) for c in right.columns])
        return left.crossJoin(renamed)
    keys = [f"_key{i}" for i in range(len(right_on))]
    if kind in ("left_semi", "left_anti"):
        only = right.select(*[F.col(quoted(c)).alias(k) for c, k in zip(right_on, keys)])
        return equi_join(left, only, left_on, keys, kind)
    kept = [c for c in right.columns if c not in right_on or (kind == "full" and not coalesce_keys)]
    names = {c: _free_name(c, suffix, taken) for c in kept}
    side = right.select(*[F.col(quoted(c)).alias(k) for c, k in zip(right_on, keys)],
                        *[F.col(quoted(c)).alias(n) for c, n in names.items()])
    joined = equi_join(left, side, left_on, keys, kind)
    key_of = dict(zip(left_on, keys))
    out = [F.coalesce(F.col(quoted(c)), F.col(key_of[c])).alias(c) if coalesce_keys and c in key_of
           else F.col(quoted(c)) for c in left.columns]
    return joined.select(*out, *[F.col(quoted(n)) for n in names.values()])
