"""Intermediate tables in the shared folder, and small frame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bits of the table that maybe_among sends to all tasks: 2^23 bits in 2^17 words of 8 bytes, whatever the number of ids.
_FILTER_BITS = 23


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and Spark runs in one process, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet and read again: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table holds."""
    return docs.select(*(docs[f"`{x}`"] for x in names))


def maybe_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`df` with a boolean `_maybe`: false where the id is surely not in `ids` (one column), without a shuffle of `df`.

    The ids are folded into a bit table of fixed size, which is broadcast. With very many ids it lets more rows through, so
    those with `_maybe` still need an exact join. A null id is never among them.
    """
    cell = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << _FILTER_BITS))
    name = ids.columns[0]
    bits = (ids.where(F.col(name).isNotNull()).select(cell(F.col(name)).alias("_among_cell")).groupBy(F.expr("_among_cell div 64").alias("_among_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_among_cell % 64 as int))")).alias("_among_mask")))
    own = df.withColumn("_among_cell", cell(df[column]))
    seen = F.expr("_among_mask is not null and (shiftright(_among_mask, cast(_among_cell % 64 as int)) & 1L) = 1") & F.col(column).isNotNull()
    return own.join(F.broadcast(bits), F.expr("_among_cell div 64 = _among_word"), "left").withColumn("_maybe", seen).drop("_among_cell", "_among_word", "_among_mask")


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of `df` whose id is not in `gone` (one column; null matches null). Only rows that may be in it are shuffled."""
    marked = maybe_among(df, column, gone)
    rest = marked.where(F.col("_maybe") | F.col(column).isNull()).drop("_maybe")
    name = gone.columns[0]
    return marked.where(~F.col("_maybe") & F.col(column).isNotNull()).drop("_maybe").unionAll(rest.join(gone, rest[column].cast("long").eqNullSafe(gone[name]), "left_anti"))
