"""Derived-column recipes: ordered ``{field: SQL expression}`` kept as JSON and applied to any table."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from .columns import create_column


class Recipe:
    """Latest expression per field, in the order the fields were last set; dropping a field forgets it."""

    def __init__(self, steps: Mapping[str, str] | None = None):
        self._steps = dict(steps or {})

    def record(self, field: str, expression: str) -> "Recipe":
        self._steps.pop(field, None)
        self._steps[field] = expression
        return self

    def forget(self, *fields: str) -> "Recipe":
        for f in fields:
            self._steps.pop(f, None)
        return self

    @property
    def steps(self) -> dict[str, str]:
        return dict(self._steps)

    def to_json(self) -> str:
        return json.dumps(self._steps, indent=4)

    @classmethod
    def from_json(cls, text: str) -> "Recipe":
        return cls(json.loads(text))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> "Recipe":
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())


def apply_recipe(df: DataFrame, recipe: Recipe | Mapping[str, str] | str) -> DataFrame:
    """Add every recipe column in order; all of it is one projection chain that Catalyst collapses."""
    if isinstance(recipe, str):
        recipe = Recipe.from_json(recipe)
    steps = recipe.steps if isinstance(recipe, Recipe) else dict(recipe)
    for field, expression in steps.items():
        df = create_column(df, field, expression)
    return df
