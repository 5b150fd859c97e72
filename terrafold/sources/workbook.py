"""Workbooks (.xlsx) as a Spark data source: a partition per sheet, rows streamed from the zipped XML.

``spark.read.format("workbook").load(folder or file)`` gives (path, sheet, row,
cells): the cells of every row that has any, as text, in the order of columns.
Only names of files and sheets are read on the driver. A task opens its file by
range, keeps the workbook's shared strings and parses one row after the other.
Dates, which a workbook stores as numbers with a date format, become ISO texts;
booleans TRUE and FALSE; errors nothing. ``header_rows``, ``sheet_table`` and
``titled_rows`` find headers on the executors and name columns by them.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet string, row int, cells array<string>"
#: Fixed: built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Letters of a number format that stand for parts of a date, outside quotes, brackets and escapes.
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.')


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """Addresses of the .xlsx files at ``path``: a file, or a folder with them at any depth."""
    from pyarrow import fs

    system, inner = _filesystem(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx") and not f.base_name.startswith("~$"))


def _open(path: str) -> zipfile.ZipFile:
    system, inner = _filesystem(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part of the archive) of every sheet, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    names = []
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _plain(node.tag) == "sheet":
            target = targets[node.get(_REL)]
            names.append((node.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return names


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _plain(t.tag) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if _plain(node.tag) == "si":
                found.append(_text(node))
                node.clear()
    return found


def _date_styles(book: zipfile.ZipFile) -> tuple[set[int], datetime]:
    """Numbers of the cell styles that are dates, and the day that counts as 0."""
    own, styles = {}, set()
    if "xl/styles.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/styles.xml"))
        for node in root.iter():
            if _plain(node.tag) == "numFmt":
                own[int(node.get("numFmtId"))] = bool(re.search("[ymdhs]", _QUOTED.sub("", node.get("formatCode") or "").lower()))
        for group in root:
            if _plain(group.tag) == "cellXfs":
                for k, style in enumerate(group):
                    number = int(style.get("numFmtId") or 0)
                    if own.get(number, number in DATE_FORMATS):
                        styles.add(k)
    later = any(_plain(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter())
    return styles, datetime(1904, 1, 1) if later else datetime(1899, 12, 30)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(node: ElementTree.Element, shared: list[str], dates: set[int], first: datetime) -> str | None:
    kind, value = node.get("t"), next((x for x in node if _plain(x.tag) == "v"), None)
    if kind == "inlineStr":
        return _text(node)
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    if kind is None and node.get("s") and int(node.get("s")) in dates:
        at = first + timedelta(seconds=round(float(value.text) * 86_400))
        return at.strftime("%Y-%m-%d" if (at.hour, at.minute, at.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")
    return value.text


def rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """(number from 1, cells) of every row of a sheet that has a value."""
    shared, (dates, first) = _shared(book), _date_styles(book)
    number = 0
    with book.open(part) as sheet:
        for _, node in ElementTree.iterparse(sheet):
            if _plain(node.tag) != "row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for k, cell in enumerate(c for c in node if _plain(c.tag) == "c"):
                at = _column(cell.get("r")) if cell.get("r") else max(k, len(cells))
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _cell(cell, shared, dates, first)
            node.clear()
            if any(c not in (None, "") for c in cells):
                yield number, cells


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, part: str):
        super().__init__((path, sheet, part))
        self.path, self.sheet, self.part = path, sheet, part


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in workbook_files(self.path):
            with _open(path) as book:
                found += [_Sheet(path, name, part) for name, part in sheets(book) if self.only in (None, name)]
        return found

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with _open(partition.path) as book:
            for number, cells in rows(book, partition.part):
                yield partition.path, partition.sheet, number, cells


class Workbook(DataSource):
    """``spark.read.format("workbook").option("sheet", name).load(path)``; without a sheet's name all of them."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"))


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, cells) of workbooks."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def _canonical(synonyms: dict[str, str]) -> Column:
    """The row's cells by their canonical names, NULL where a cell is no known header."""
    names = F.create_map(*[F.lit(x) for k, v in {k.strip().lower(): v for k, v in synonyms.items()}.items() for x in (k, v)])
    return F.transform("cells", lambda c: F.try_element_at(names, F.lower(F.trim(F.coalesce(c, F.lit(""))))))


def header_rows(cells: DataFrame, synonyms: dict[str, str], needed: tuple[str, ...], try_rows: int = 4) -> DataFrame:
    """(path, sheet, header, names) per sheet: the first of its first ``try_rows`` rows that has all ``needed`` names."""
    named = cells.filter(F.col("row") <= try_rows).withColumn("names", _canonical(synonyms))
    has = F.size(F.array_except(F.array(*map(F.lit, needed)), "names")) == 0
    return named.filter(has).groupBy("path", "sheet").agg(F.min(F.struct("row", "names")).alias("h")).select("path", "sheet", F.col("h.row").alias("header"), F.col("h.names").alias("names"))


def sheet_table(cells: DataFrame, synonyms: dict[str, str], needed: tuple[str, ...], columns: list[str], try_rows: int = 4) -> DataFrame:
    """(path, sheet, row, ``columns``) below the header of each sheet that has one (S10); names that a sheet lacks are NULL.

    Rows without the first needed value, and headers that repeat, are left out.
    """
    body = cells.join(header_rows(cells, synonyms, needed, try_rows), ["path", "sheet"]).filter(F.col("row") > F.col("header"))
    at = lambda c: F.array_position("names", F.lit(c)).cast("int")
    value = lambda c: F.when(at(c) > 0, F.get("cells", at(c) - 1)).alias(c)
    out = body.withColumn("_again", _canonical(synonyms)).select("path", "sheet", "row", "_again", *[value(c) for c in columns])
    first = F.coalesce(F.trim(F.col(needed[0])), F.lit(""))
    return out.filter((first != "") & ~F.array_contains(F.coalesce(F.array_compact("_again"), F.array().cast("array<string>")), needed[0])).drop("_again")


def titled_rows(cells: DataFrame, marks: tuple[str, ...] = ("البيان", "Title"), footers: tuple[str, ...] = ("المصدر", "Source")) -> DataFrame:
    """(path, sheet, row, cells) below the first row that holds one of ``marks``, without footer rows (S11); sheets without one have none."""
    whole = F.array_join(F.array_compact("cells"), " ")
    holds = lambda words: F.coalesce(*[F.when(whole.contains(w), F.lit(True)) for w in words], F.lit(False))
    first = cells.filter(holds(marks)).groupBy("path", "sheet").agg(F.min("row").alias("title_row"))
    return cells.join(first, ["path", "sheet"]).filter((F.col("row") > F.col("title_row")) & ~holds(footers)).select("path", "sheet", "row", "cells")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """Daily rates of all sheets of all workbooks (S10): one row a day from 2000 to 2030, the last file, sheet and row of a day wins."""
    from ..functions import dates
    from ..operators.clean import first_row
    from .readers import RATE_HEADERS
    from .schemas import TENORS

    table = sheet_table(read(spark, path), RATE_HEADERS, ("date", "3_month"), ["date", *TENORS])
    day = F.coalesce(F.try_to_date("date", "yyyy-MM-dd"), dates.parse_flexible(F.col("date")))
    typed = table.select("path", "sheet", "row", day.alias("date"), *[F.col(f"`{t}`").try_cast("double").alias(t) for t in TENORS])
    known = typed.filter(F.year("date").between(2000, 2030))
    return first_row(known, ["date"], [F.col("path").desc(), F.col("sheet").desc(), F.col("row").desc()]).drop("path", "sheet", "row")
