"""The first sheet of XLSX workbooks as typed rows. A workbook is one task's work, as the format holds at most 1,048,576 rows a sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 10_000
CELLS = "source_path string, epoch_1904 boolean, cells array<string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    """Text of a string node with its runs, phonetic hints left out."""
    return "".join(t.text or "" for part in node if _local(part.tag) in ("t", "r") for t in part.iter() if _local(t.tag) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return [_text(n) for _, n in ElementTree.iterparse(f) if _local(n.tag) == "si"]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The first sheet's part, and whether days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(n for n in root.iter() if _local(n.tag) == "sheet")
    ref = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(n.attrib["Target"] for n in rels if n.attrib["Id"] == ref)
    late = any(n.attrib.get("date1904") in ("1", "true") for n in root.iter() if _local(n.tag) == "workbookPr")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", late


def _column(ref: str) -> int:
    place = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.attrib.get("t", "n")
    if kind == "inlineStr":
        return next((_text(n) for n in cell if _local(n.tag) == "is"), None)
    value = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    return shared[int(value)] if kind == "s" else value


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[dict[int, str]]:
    shared = _shared(book)
    with book.open(part) as f:
        for _, row in ElementTree.iterparse(f):
            if _local(row.tag) == "row":
                found: dict[int, str] = {}
                for i, cell in enumerate(n for n in row if _local(n.tag) == "c"):
                    value = _value(cell, shared)
                    if value is not None:
                        found[_column(cell.attrib["r"]) if "r" in cell.attrib else i] = value
                yield found
                row.clear()


def _cells(names: list[str]):
    """A function of Arrow batches of (path, content): cells of the named columns, found by the header line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                book = zipfile.ZipFile(io.BytesIO(content.as_py()))
                part, late = _first_sheet(book)
                rows = _rows(book, part)
                header = {text.strip().lower(): i for i, text in reversed(next(rows, {}).items())}
                places, held = [header.get(n.lower(), -1) for n in names], []

                def batch_of(held):
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([late] * len(held)), pa.array(held, pa.list_(pa.string()))], ["source_path", "epoch_1904", "cells"])

                for row in rows:
                    held.append([row.get(i) for i in places])
                    if len(held) == BATCH:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return read


def _typed(cell: Column, kind: T.DataType) -> Column:
    """A cell as its column's type, null where it is none; days are texts (yyyy-MM-dd) or numbers from 1899-12-30 (from 1904-01-01 where the workbook says so)."""
    cell = F.nullif(F.trim(cell), F.lit(""))
    if isinstance(kind, T.DateType):
        first = F.when(F.col("epoch_1904"), F.lit("1904-01-01")).otherwise(F.lit("1899-12-30")).cast("date")
        return F.coalesce(F.try_to_date(F.substring(cell, 1, 10), "yyyy-MM-dd"), F.date_add(first, F.floor(cell.try_cast("double")).cast("int")))
    if isinstance(kind, T.IntegralType):
        return cell.try_cast("double").try_cast(kind)
    return cell.try_cast(kind)


def read_workbooks(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Columns of schema, by header name in any case (null where a workbook lacks one), and source_path. Error cells and blank ones are null."""
    fields = T.StructType.fromDDL(schema).fields
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    cells = found.mapInArrow(_cells([f.name for f in fields]), CELLS)
    return cells.select(*[_typed(F.col("cells")[i], f.dataType).alias(f.name) for i, f in enumerate(fields)], "source_path")
