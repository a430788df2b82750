"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tablekit", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive planning, skew splitting and a UTC clock; pass more settings as keywords.

    Shuffle partitions are left to adaptive coalescing. Keyword ``a__b`` stands for setting ``a.b``.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
