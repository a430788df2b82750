"""Run row-wise operators on files as they arrive.

Filters on values, type conversion, derived columns and scalar functions are plain Columns, so a
streaming DataFrame takes them unchanged. Operators that need row order, exact quantiles or a pivot are batch only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def process_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                      timeout: int | None = None) -> None:
    """Apply ``transform`` to all files not yet seen and append the result to ``path`` as Parquet, exactly once.

    ``checkpoint`` is the stream's own progress folder; keep it on shared storage.
    """
    if not stream.isStreaming:
        raise ValueError("not a streaming table")
    query = (transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).outputMode("append").start(path))
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
