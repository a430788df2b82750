"""Records of delimited text whose quoted cells hold line breaks, from splits that are read independently.

A line either leaves the reader inside a quoted cell or not, depending on whether it began inside one. Composing this effect over the lines of
a split, then over the splits of a file, tells in which state each split begins; then every split cuts its own
records, and the few records that cross splits are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.layout import durable
from .sniff import raw_lines

_COMPLETE, _HEAD, _TAIL = 0, 1, 2


def line_effect(delimiter: str, quote: str) -> Callable[[bytes, int], int]:
    """Whether a line ends inside a quoted cell (1), given whether it begins inside one. Quotes open a cell at its beginning only, a doubled one
    does not close it, and what follows a closing one belongs to the cell."""
    d, q = re.escape(delimiter.encode()), re.escape(quote.encode())
    inside = b"[^%b]*+(?:%b%b[^%b]*+)*+" % (q, q, q, q)
    open_ = re.compile(b"(?:(?:%b%b%b[^%b]*+|[^%b%b][^%b]*+)?+%b)*+%b%b\\Z" % (q, inside, q, d, d, q, d, d, q, inside))
    close = re.compile(b"%b(?:\\Z|%b[^%b]*+(?:(%b)|\\Z))" % (inside, q, d, d))
    sign = quote.encode()

    def effect(line: bytes, began: int) -> int:
        if sign not in line:
            return began
        if not began:
            return int(open_.match(line) is not None)
        found = close.match(line)
        if found.group(1) is not None:
            return int(open_.match(line, found.end()) is not None)
        return int(line.count(sign, 0, found.end()) % 2 == 0)  # an even number is of doubled ones only: not closed

    return effect


def _split_effects(lines: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """file, start, from0, from1: the state after each split that holds a quote, for either state before it."""
    effect = line_effect(delimiter, quote)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states = None, [0, 1]
        done: list[tuple] = []
        for batch in batches:
            for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != at:
                    if at:
                        done.append((*at, *states))
                    at, states = (file, start), [0, 1]
                states = [effect(value, s) for s in states]
        if at:
            done.append((*at, *states))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "from0", "from1"), x)) for x in done],
                                         pa.schema([("file", pa.string()), ("start", pa.int64()), ("from0", pa.int32()), ("from1", pa.int32())]))

    quoted = lines.where(F.contains("value", F.lit(quote))).select(F.col("value").cast("binary").alias("value"), "file", "start")
    return quoted.mapInArrow(run, "file string, start long, from0 int, from1 int")


def split_states(lines: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """file, start, opens (the split begins inside a quoted cell), ends (it ends inside one): a row per split. How a file is split depends
    on what is read with it, so the splits are those of `lines` itself."""
    def compose(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("start")
        state, opens, ends = 0, [], []
        for a, b in zip(some["from0"], some["from1"]):
            opens.append(state)
            state = int((a, b)[state])
            ends.append(state)
        return some.assign(opens=opens, ends=ends)[["file", "start", "opens", "ends"]]

    effects = lines.select("file", "start").distinct().join(_split_effects(lines, delimiter, quote), ["file", "start"], "left").na.fill({"from0": 0, "from1": 1})
    return effects.groupBy("file").applyInPandas(compose, "file string, start long, opens int, ends int")


def _cut(lines: DataFrame, delimiter: str, quote: str, crossing: bool) -> DataFrame:
    """The records that lie within a split, or with `crossing` the pieces of those that don't: file, start, seq (of the record in its split), kind, value."""
    effect = line_effect(delimiter, quote)
    shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, parts, kind, state, out = None, 0, [], _COMPLETE, 0, []

        def end(last: int) -> None:
            """`last`: what a record is that is not closed by now."""
            nonlocal parts, seq
            what = last or kind
            value = b"\n".join(parts)
            if what != _COMPLETE or value.strip():
                if (what != _COMPLETE) == crossing:
                    out.append((*at, seq, what, value))
                seq += what != _HEAD
            parts = []

        for batch in batches:
            for value, file, start, opens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, start) != at:
                    if parts:
                        end(kind or _TAIL)
                    at, seq, state = (file, start), 0, opens
                    kind = _HEAD if opens else _COMPLETE
                parts.append(value)
                state = effect(value, state)
                if not state:
                    end(0)
                    kind = _COMPLETE
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
                out.clear()
        if parts:
            end(kind or _TAIL)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return lines.select(F.col("value").cast("binary").alias("value"), "file", "start", "opens").mapInArrow(run, "file string, start long, seq long, kind int, value binary")


def quoted_records(spark: SparkSession, path: str | Sequence[str], delimiter: str, quote: str) -> DataFrame:
    """value (bytes of a record without its last line break), file, start, seq: in file order, a record is at the split where it begins
    and its number in there. Blank records are left out.

    The table of states has a row per split of the input and is sent to all tasks. A record that crosses splits is put together in one task.
    """
    lines = raw_lines(spark, path).drop("place")
    states = durable(split_states(lines, delimiter, quote))
    changed = F.raise_error(F.lit("the input files changed between two reads")).cast("int")
    known = lines.join(F.broadcast(states.drop("ends")), ["file", "start"], "left").withColumn("opens", F.when(F.col("opens").isNull(), changed).otherwise(F.col("opens")))
    whole = _cut(known, delimiter, quote, False).drop("kind")
    torn = states.where("opens = 1 or ends = 1")
    if torn.isEmpty():
        return whole.select("value", "file", "start", "seq")
    pieces = _cut(lines.join(F.broadcast(torn.drop("ends")), ["file", "start"]), delimiter, quote, True)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("record", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "seq", "value"))).alias("parts"))
    joined = joined.select(F.expr("array_join(transform(parts, p -> hex(p.value)), '0A')").alias("hex"), "file", F.col("parts")[0].start.alias("start"), F.col("parts")[0].seq.alias("seq"))
    return whole.select("value", "file", "start", "seq").unionByName(joined.select(F.unhex("hex").alias("value"), "file", "start", "seq"))
