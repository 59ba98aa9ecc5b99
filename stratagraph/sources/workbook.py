"""Sheets of .xlsx workbooks as tables of text, without another library: the format is a zip archive of XML documents.

spark.read.format("workbook").option("sheet", "Area - proteins").load("/data/areas.xlsx"), once register() was called; read() does both and reads files that only Spark reaches too.
The first row names the columns. Each partition inflates the sheet as a stream and parses its own range of rows, one row at a time; shared texts are held by each reader.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of a sheet that one partition reads, unless the option rowsPerPartition says otherwise, and rows of a batch that goes to Spark.
ROWS, BATCH = 50_000, 2000
_LETTERS = re.compile(r"[A-Z]+")


def _tag(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e: Element, name: str) -> str:
    """An attribute by its name without the namespace."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _elements(archive: zipfile.ZipFile, part: str, wanted: str) -> Iterator[Element]:
    """The elements of one kind in a part, each forgotten once it was seen."""
    with archive.open(part) as f:
        parents: list[Element] = []
        for event, e in iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if _tag(e) == wanted:
                yield e
                if parents:
                    parents[-1].remove(e)


def sheets(archive: zipfile.ZipFile) -> dict[str, str]:
    """The part of each sheet, in the workbook's order."""
    targets = {_attribute(e, "Id"): _attribute(e, "Target") for e in _elements(archive, "xl/_rels/workbook.xml.rels", "Relationship")}
    return {_attribute(e, "name"): posixpath.normpath(posixpath.join("/xl", targets[_attribute(e, "id")])).lstrip("/") for e in _elements(archive, "xl/workbook.xml", "sheet")}


def part_of(archive: zipfile.ZipFile, sheet: str | None) -> str:
    known = sheets(archive)
    if sheet is None:
        return next(iter(known.values()))
    if sheet not in known:
        raise ValueError(f"no sheet {sheet}; there are {', '.join(known)}")
    return known[sheet]


def _text(e: Element) -> str:
    """All runs of a rich text; what says how it is pronounced isn't part of it."""
    return "".join(t.text or "" for x in e if _tag(x) in ("t", "r") for t in ([x] if _tag(x) == "t" else [y for y in x if _tag(y) == "t"]))


def shared_texts(archive: zipfile.ZipFile) -> list[str]:
    return [_text(e) for e in _elements(archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in archive.namelist() else []


def _column(reference: str) -> int:
    n = 0
    for c in _LETTERS.match(reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: Element, texts: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(x) for x in cell if _tag(x) == "is"), None)
    value = next((x.text for x in cell if _tag(x) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(value)]
    return {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def rows(archive: zipfile.ZipFile, part: str, texts: list[str], first: int = 1, last: int | None = None) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Number (from 1) and cells by column of the rows from first to last; rows without cells may be missing. Cells and rows without a reference follow the one before."""
    n = 0
    for row in _elements(archive, part, "row"):
        n = int(row.get("r", n + 1))
        if last is not None and n > last:
            return
        if n >= first:
            at, cells = -1, {}
            for cell in row:
                if _tag(cell) == "c":
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    cells[at] = _value(cell, texts)
            yield n, cells


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def header(archive: zipfile.ZipFile, part: str, texts: list[str]) -> tuple[int, list[str]]:
    """The number of the first row with cells, and the columns' names: a column without one is named by its letters, one whose name was there gets them behind it."""
    for n, cells in rows(archive, part, texts):
        if any(v is not None for v in cells.values()):
            names: list[str] = []
            for i in range(max(cells) + 1):
                name = (cells.get(i) or "").strip() or _letters(i)
                names.append(f"{name}_{_letters(i)}" if name.lower() in {x.lower() for x in names} else name)
            return n, names
    return 0, []


def last_row(archive: zipfile.ZipFile, part: str) -> int | None:
    """The last row that the sheet says it has, if it does."""
    with archive.open(part) as f:
        found = re.search(rb"<(?:\w+:)?dimension[^>]*ref=\"[A-Z]+\d+:[A-Z]+(\d+)\"", f.read(4096))
    return int(found[1]) if found else None


def batches(archive: zipfile.ZipFile, part: str, texts: list[str], names: list[str], first: int, last: int | None) -> Iterator[pa.RecordBatch]:
    def batch(some: list[dict[int, str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c.get(i) for c in some], pa.string()) for i in range(len(names))], names=names)

    held: list[dict[int, str | None]] = []
    for _, cells in rows(archive, part, texts, first, last):
        if any(v is not None for v in cells.values()):
            held.append(cells)
        if len(held) == BATCH:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _file(path: str) -> BinaryIO:
    return open(re.sub("^file:/+", "/", path), "rb")  # noqa: SIM115 - closed with the archive that reads it


class RowRange(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, most: int, names: list[str]):
        self.path, self.sheet, self.most, self.names = path, sheet, most, names

    def partitions(self) -> list[RowRange]:
        """Ranges of rows; the last one is open, as a sheet may have more than it says."""
        with _file(self.path) as f, zipfile.ZipFile(f) as archive:
            part = part_of(archive, self.sheet)
            first = header(archive, part, shared_texts(archive))[0] + 1
            starts = list(range(first, max(last_row(archive, part) or 0, first) + 1, self.most))
        return [RowRange(a, b - 1 if b else None) for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        with _file(self.path) as f, zipfile.ZipFile(f) as archive:
            yield from batches(archive, part_of(archive, self.sheet), shared_texts(archive), self.names, partition.first, partition.last)


class Workbook(DataSource):
    """Options: path (a file that driver and executors can open), sheet (the first one), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheet(self) -> str | None:
        return self.options.get("sheet")

    def schema(self) -> StructType:
        with _file(self.options["path"]) as f, zipfile.ZipFile(f) as archive:
            names = header(archive, part_of(archive, self._sheet()), shared_texts(archive))[1]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self._sheet(), int(self.options.get("rowsPerPartition", ROWS)), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)


def _from_store(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    """A workbook in a store that only Spark reads: its bytes are one row, read by one task."""
    content = spark.read.format("binaryFile").load(path).select("content")

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for c in b.column(0):
                with zipfile.ZipFile(io.BytesIO(c.as_py())) as archive:
                    yield pa.RecordBatch.from_arrays([pa.array(header(archive, part_of(archive, sheet), shared_texts(archive))[1], pa.string())], names=["name"])

    names = [r[0] for r in content.mapInArrow(named, "name string").collect()]  # of columns

    def read_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for c in b.column(0):
                with zipfile.ZipFile(io.BytesIO(c.as_py())) as archive:
                    part, texts = part_of(archive, sheet), shared_texts(archive)
                    yield from batches(archive, part, texts, names, header(archive, part, texts)[0] + 1, None)

    return content.mapInArrow(read_rows, StructType([StructField(n, StringType()) for n in names]))


def read(spark: SparkSession, path: str, sheet: str | None = None, rows_per_partition: int = ROWS) -> DataFrame:
    """All columns of a sheet (the first one) as text."""
    if re.match(r"^(?!file:)[a-z0-9+.-]+:/", path):
        return _from_store(spark, path, sheet)
    register(spark)
    source = spark.read.format("workbook").option("rowsPerPartition", str(rows_per_partition))
    return (source.option("sheet", sheet) if sheet else source).load(path)
