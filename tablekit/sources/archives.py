"""Workbooks and NumPy archives: many files in parallel, one file per task.

Spark has no splittable source for these containers. Each task opens whole files (``binaryFile`` holds
at most 2 GiB each) and emits rows in batches; everything after that is ordinary Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.columns import header_names
from ..plans.layout import quoted

_BATCH = 5_000
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# -- workbooks -------------------------------------------------------------------

def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, part name)`` in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
    full = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), full(targets[s.get(f"{_REL}id")])) for s in sheets]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in root.iter(f"{_SHEET}si")]


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


def _sheet_rows(content: bytes, wanted: str | None) -> Iterator[tuple[str, int, bool, list[str | None]]]:
    """``(sheet, row number, is the first row, cells)``; the sheet is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = _sheet_parts(book)
        named = [s for s in sheets if s[0] == wanted] if wanted and len(sheets) > 1 else []
        name, part = (named or sheets)[0]
        shared = _shared_strings(book)
        with book.open(part) as stream:
            number, first = 0, True
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_SHEET}row":
                    continue
                number = int(node.get("r") or number + 1)
                cells: list[str | None] = []
                for cell in node.iter(f"{_SHEET}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell_text(cell, shared)
                yield name, number, first, cells
                first = False
                node.clear()


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheet names per workbook: ``(file, position, sheet)``."""
    def scan(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(file, i, name) for i, (name, _) in enumerate(_sheet_parts(book))]
            yield pd.DataFrame(rows, columns=["file", "position", "sheet"])

    return _files(spark, path).mapInPandas(scan, "file string, position int, sheet string")


def workbook_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of one sheet per workbook as ``(file, sheet, row_no, is_first, cells)``; the first sheet unless named."""
    columns = ["file", "sheet", "row_no", "is_first", "cells"]

    def scan(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in _sheet_rows(content, sheet):
                    rows.append((file, *row))
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return _files(spark, path).mapInPandas(
        scan, "file string, sheet string, row_no int, is_first boolean, cells array<string>")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Workbooks as one table of strings; the first row of each file is its header, names come from one file."""
    cells = workbook_cells(spark, path, sheet)
    found = cells.agg(F.max(F.size("cells")).alias("width"),
                      F.min_by("cells", F.when(F.col("is_first"), F.col("file"))).alias("names")).first()
    if found["width"] is None:
        raise ValueError(f"no rows in {path}")
    names = header_names(list(found["names"]) + [None] * (found["width"] - len(found["names"])))
    return cells.where(~F.col("is_first")).select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


# -- NumPy archives ----------------------------------------------------------------

def list_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Arrays per archive: ``(file, array, shape, dtype)``."""
    def scan(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for name in archive.files:
                        array = archive[name]
                        fields = list(array.dtype.names or [])
                        rows.append((file, name, list(array.shape), str(array.dtype), fields,
                                     [array.dtype[f].kind for f in fields] or [array.dtype.kind]))
            yield pd.DataFrame(rows, columns=["file", "array", "shape", "dtype", "fields", "kinds"])

    return _files(spark, path).mapInPandas(
        scan, "file string, array string, shape array<bigint>, dtype string, fields array<string>, kinds array<string>")


_KINDS = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean", "U": "string", "S": "string", "M": "timestamp_ntz"}


def read_npz(spark: SparkSession, path: str, array: str | None = None, prefix: str = "col") -> DataFrame:
    """One array of every archive as a table: 1-D gives one column, 2-D ``<prefix>_<i>``, structured its fields."""
    listed = list_arrays(spark, path).orderBy("file", "array")
    if array is None:
        names = [r[0] for r in listed.select("array").distinct().take(2)]
        if len(names) != 1:
            raise ValueError("several arrays in the archive; name one")
        array = names[0]
    info = listed.where(F.col("array") == array).first()
    if info is None:
        raise ValueError(f"no array {array!r}")
    shape, fields, kinds = list(info["shape"]), list(info["fields"]), list(info["kinds"])
    if fields and len(shape) <= 1:
        columns = list(zip(fields, kinds))
    elif len(shape) == 1:
        columns = [(array, kinds[0])]
    elif len(shape) == 2:
        columns = [(f"{prefix}_{i}", kinds[0]) for i in range(shape[1])]
    else:
        raise ValueError(f"array {array!r} has {len(shape)} dimensions; only 1 or 2 can be a table")
    titles = [c for c, _ in columns]

    def scan(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    if array not in archive.files:
                        continue
                    data = np.atleast_1d(archive[array])
                for at in range(0, len(data), _BATCH):
                    part = data[at:at + _BATCH]
                    cells = [part[f] for f in fields] if fields else [part] if part.ndim == 1 else list(part.T)
                    yield pd.DataFrame(dict(zip(titles, cells)), columns=titles)

    schema = ", ".join(f"{quoted(c)} {_KINDS.get(k, 'string')}" for c, k in columns)
    return _files(spark, path).mapInPandas(scan, schema)
