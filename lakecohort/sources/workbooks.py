"""Workbooks (.xlsx) as a Spark data source: sheets in ranges of rows, parsed as a stream where they are read.

    spark.dataSource.register(Workbooks)
    spark.read.format("workbook").option("sheet", "Visits").schema("SUBJID string, VISDAT string").load("/shared/visits.xlsx")

Without a schema the first row of the sheet names the columns; only that row is read for it. All cells are texts. A workbook is
a zip archive, so its path must be one that executors can open and seek in. A task unpacks its sheet up to its last row, holds
one row at a time, and the workbook's shared texts, which all cells of a workbook point into, if there are any.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of one partition.
ROWS = 100_000


def sheets(path: str) -> dict[str, str]:
    """Sheet names and the archive's members that hold them."""
    with zipfile.ZipFile(path) as z:
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): links[s.get(LINK)].lstrip("/") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets")}
    return {name: member if member.startswith("xl/") else f"xl/{member}" for name, member in found.items()}


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what has been seen is let go."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == MAIN + tag:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in _elements(f, "si")]


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    at = 0
    for x in re.match(r"[A-Z]*", reference)[0]:
        at = 26 * at + ord(x) - 64
    return at - 1


def rows(path: str, member: str, first: int = 1, past: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet from row first up to row past."""
    with zipfile.ZipFile(path) as z:
        shared = _shared(z)
        with z.open(member) as f:
            number = 0
            for row in _elements(f, "row"):
                number = int(row.get("r") or number + 1)
                if past is not None and number >= past:
                    return
                if number < first:
                    continue
                cells: list[str | None] = []
                for c in row.findall(f"{MAIN}c"):
                    at = column_number(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                    elif value is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if c.get("t") == "s" else value.text)
                yield number, cells


def height(path: str, member: str) -> int | None:
    """The last row that the sheet names in its dimension, if it has one."""
    with zipfile.ZipFile(path) as z, z.open(member) as f:
        found = re.search(rb'<(?:\w+:)?dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', f.read(4096))
    return int(found[1]) if found else None


class Rows(InputPartition):
    def __init__(self, first: int, past: int | None):
        self.first, self.past = first, past


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, member: str, width: int, size: int):
        self.path, self.member, self.width, self.size = path, member, width, size

    def partitions(self) -> list[Rows]:
        """Ranges of rows below the header; the last is open, as a dimension can be out of date."""
        starts = list(range(2, max(3, (height(self.path, self.member) or 0) + 1), self.size))
        return [Rows(a, b) for a, b in zip(starts, [*starts[1:], None])]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for _, cells in rows(self.path, self.member, partition.first, partition.past):
            yield tuple([*cells[: self.width], *[None] * (self.width - len(cells))])


class Workbooks(DataSource):
    """Options: path, sheet (the first without) and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _place(self) -> tuple[str, str]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        found = sheets(path)
        sheet = self.options.get("sheet") or next(iter(found))
        if sheet not in found:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        return path, found[sheet]

    def schema(self) -> StructType:
        from lakecohort.sources.files import unique_names

        _, head = next(rows(*self._place()), (0, []))
        return StructType([StructField(n, StringType()) for n in unique_names(head)])

    def reader(self, schema: StructType) -> WorkbookReader:
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("cells of a workbook are texts")
        return WorkbookReader(*self._place(), len(schema.fields), int(self.options.get("rowsperpartition") or self.options.get("rowsPerPartition") or ROWS))
