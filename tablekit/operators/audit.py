"""Step audit: row counts observed while the data flows, appended to an audit table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

AUDIT_SCHEMA = ("app string, category string, description string, details string, rows_before bigint, "
                "columns_before int, rows_after bigint, columns_after int, logged_at timestamp")


class Audit:
    """Collects steps and writes them as one small table.

    Row counts ride along as observed metrics of the job that runs anyway, so auditing starts no job.
    """

    def __init__(self, app: str):
        self.app = app
        self._steps: list[dict] = []

    def observed(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        watch = Observation(f"{name}-{len(self._steps)}")
        return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch

    def step(self, before: DataFrame, after: DataFrame, category: str, description: str,
             details: dict | None = None) -> DataFrame:
        """Watch ``after`` and remember the step; read the count once an action has run on the result."""
        watched, watch = self.observed(after, category)
        self._steps.append({"category": category, "description": description, "details": details or {},
                            "columns_before": len(before.columns), "columns_after": len(after.columns), "after": watch})
        return watched

    def load(self, df: DataFrame, path: str, details: dict | None = None) -> DataFrame:
        watched, watch = self.observed(df, "load")
        self._steps.append({"category": "load", "description": f"Loaded {path}", "details": details or {},
                            "columns_before": None, "columns_after": len(df.columns), "after": watch})
        return watched

    def saved(self, df: DataFrame, path: str, details: dict | None = None) -> None:
        self._steps.append({"category": "save", "description": f"Saved {path}", "details": details or {},
                            "columns_before": len(df.columns), "columns_after": len(df.columns), "after": None})

    def rows(self) -> list[tuple]:
        """Finished steps; a step's rows-before is the rows-after of the step before it."""
        out, last = [], None
        for s in self._steps:
            after = s["after"].get["rows"] if s["after"] is not None else last
            out.append((self.app, s["category"], s["description"], json.dumps(s["details"], sort_keys=True),
                        last, s["columns_before"], after, s["columns_after"], datetime.now(timezone.utc)))
            last = after
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), AUDIT_SCHEMA)

    def append_to(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("append").parquet(path)
