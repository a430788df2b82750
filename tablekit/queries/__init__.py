"""Queries over the test tables, one or more per operator, each with the SQL that must give the same rows."""

from . import aggregates, charts, columns, combining, conversion, filters, functions, reshaping, sources
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
