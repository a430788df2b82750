"""Durable layouts: reliable checkpoints, range-ordered partitions and consecutive row ids."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .sizing import rows_per_task

ROW_ID = "_row_id"

#: Columns that tell where a row stands in a set of files: the file, the split, and a number that rises within the split.
PLACE = ("_place_file", "_place_split", "_place_row")

# monotonically_increasing_id() keeps the partition number above this bit and the position below it.
_POSITION_BITS = 33


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and Spark runs in one process."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = current or tempfile.mkdtemp(prefix="tablekit-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def durable(df: DataFrame) -> DataFrame:
    """Materialise once into the checkpoint folder, so lost executors cannot change the layout."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ordering(columns: Sequence[str], descending: bool = False) -> list[Column]:
    """Sort keys with nulls first in both directions."""
    pick = (lambda c: F.col(c).desc_nulls_first()) if descending else (lambda c: F.col(c).asc_nulls_first())
    return [pick(quoted(c)) for c in columns]


def with_tie_break(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add columns that spread equal sort keys over range partitions.

    Both depend only on the row's content and its input partition, never on arrival order, so a
    re-run task assigns the same values.
    """
    if ROW_ID in df.columns:
        return df, [ROW_ID]
    content = F.xxhash64(*[F.col(c) for c in hashable(df)]) if hashable(df) else F.lit(0)
    return df.withColumns({"_tie_hash": content, "_tie_part": F.spark_partition_id()}), ["_tie_hash", "_tie_part"]


def hashable(df: DataFrame) -> list[str]:
    """Columns xxhash64 accepts (maps are refused)."""
    return [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def quoted(name: str) -> str:
    """Column reference text for any column name, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def sorted_by(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Global sort whose range partitions can cut through a hot value, rows with equal keys by row id if any."""
    tied, tie = with_tie_break(df)
    return tied.orderBy(*order, *[F.col(t) for t in tie]).select(*[F.col(quoted(c)) for c in df.columns])


def range_layout(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by ``keys`` then ``order`` and fix the layout; ``_part`` is the partition number.

    Partition numbers rise with (keys, order), and a group larger than a partition is spread over
    several neighbouring ones, so no task ever holds a whole hot group.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_task(df.sparkSession)))
    laid = df.repartitionByRange(ranges, *[F.col(quoted(k)).asc_nulls_first() for k in keys], *order)
    return durable(laid.withColumn("_part", F.spark_partition_id()))


def _plain_scan(df: DataFrame) -> tuple[bool, bool]:
    """Whether the table is a scan of files with nothing but choices of columns and rows, and whether rows were left out."""
    node, filtered = df._jdf.queryExecution().optimizedPlan(), False
    while node.nodeName() in ("Project", "Filter"):
        filtered |= node.nodeName() == "Filter"
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and bool(df.inputFiles()), filtered


def columns_apart(df: DataFrame) -> bool:
    """Whether each column can be read on its own at the price of that column: a plain scan of a columnar format."""
    if not _plain_scan(df)[0]:
        return False
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.relation().fileFormat().toString().lower() in ("parquet", "orc")


def placed_in_files(df: DataFrame) -> DataFrame | None:
    """The rows of a plain scan of files with the `PLACE` columns; None where the table is something else.

    A Parquet row knows its number in the file. Other rows keep their order within a split, so a rising number will do.
    """
    scan, filtered = _plain_scan(df)
    if not scan:
        return None
    meta = lambda name: F.col(f"_metadata.{name}")
    file = meta("file_path").alias(PLACE[0])
    try:
        if not filtered:
            return df.select("*", file, F.lit(0).cast("long").alias(PLACE[1]), meta("row_index").alias(PLACE[2]))
    except AnalysisException:  # only Parquet has it
        pass
    return df.select("*", file, meta("file_block_start").alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2]))


def numbered_by_place(placed: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Rows numbered from 0 by file path, split and place, without moving or storing them.

    A first job reads the places alone and counts the rows of each split; a row's number is that of the rows in earlier splits plus its own place in its
    split. The table of splits has a row for each (of 128 MB, unless set otherwise) and is sent to all tasks.
    """
    file, split, row = (F.col(c) for c in PLACE)
    counts = durable(placed.groupBy(file, split).agg(F.count("*").alias("_rows"), F.min(row).alias("_first")))
    before = Window.orderBy(*PLACE[:2]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(file.alias("_at_file"), split.alias("_at_split"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(starts), (file == F.col("_at_file")) & (split == F.col("_at_split")), "left")
    number = F.when(F.col("_before").isNull(), F.raise_error(F.lit("the input files changed between two reads"))).otherwise(F.col("_before") + row - F.col("_first"))
    return joined.select(*[F.col(quoted(c)) for c in placed.columns if c not in PLACE and c != name], number.cast("bigint").alias(name))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first `n` rows by file and place in it, with their `PLACE`. A plain scan reads as few files as have them. Of a table without places, any."""
    if PLACE[0] in df.columns:
        return df.orderBy(*PLACE).limit(n)
    if not _plain_scan(df)[0]:
        return df.limit(n)
    path = F.col("_metadata.file_path")
    files, some = sorted(r[0] for r in df.select(path).distinct().collect()) if len(df.inputFiles()) > 1 else [], 1
    while some < len(files) and df.where(path.isin(files[:some])).limit(n).count() < n:
        some *= 2
    return placed_in_files(df.where(path.isin(files[:some])) if files else df).orderBy(*PLACE).limit(n)


def _keeps_order(df: DataFrame) -> bool:
    """Whether the rows lie in an order that the plan gives: a global sort, a range, rows at hand, or one of these dealt out anew on demand."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter", "Repartition", "RepartitionByExpression"):
        node = node.children().head()
    return node.nodeName() in ("Range", "LocalRelation", "LogicalRDD") or node.nodeName() == "Sort" and bool(getattr(node, "global")())


def with_row_id(df: DataFrame, order_by: Sequence[str | Column] | str | Column | None = None,
                name: str = ROW_ID) -> DataFrame:
    """Add a 0-based consecutive row number in ``order_by`` order (file and place in it when omitted).

    Names in ``order_by`` sort ascending with nulls first; pass Columns for other directions. Without it, a plain scan is numbered where it
    stands, and a sorted table in its order; any other table has none, which is an error.
    The rows are sorted by Spark's range partitioner (a hot sort value is spread through a
    tie-break), written once to the checkpoint folder, and numbered from the partition's offset
    plus the position inside it. Offsets are one number per partition, hence the broadcast.
    """
    columns = [c for c in df.columns if c != name]
    source = df
    if order_by is None:
        placed = placed_in_files(df)
        if placed is not None:
            return numbered_by_place(placed, name)
        if not _keeps_order(df):
            raise ValueError("the table has no order of its own: pass order_by")
    else:
        keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        tied, tie = with_tie_break(df)
        source = tied.orderBy(*[F.col(quoted(k)).asc_nulls_first() if isinstance(k, str) else k for k in keys],
                              *[F.col(t) for t in tie])
    placed = durable(source.select(*[F.col(quoted(c)) for c in columns],
                                   F.monotonically_increasing_id().alias("_place")))
    part = F.shiftright("_place", _POSITION_BITS)
    offset, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offset.append((p, total))
        total += n
    if not offset:
        return placed.select(*[F.col(quoted(c)) for c in columns], F.lit(0).cast("bigint").alias(name))
    starts = df.sparkSession.createDataFrame(offset, "_p bigint, _start bigint")
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (placed.join(F.broadcast(starts), part == F.col("_p"))
            .select(*[F.col(quoted(c)) for c in columns], (F.col("_start") + position).alias(name)))
