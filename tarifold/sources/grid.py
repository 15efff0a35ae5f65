"""Workbooks as a Spark data source.

One input partition per (file, sheet), so workbooks are read side by side on
the executors; rows come as (source_file, sheet, row_no, cells). Cell types are
lost in a grid of texts, so numbers are rendered here: whole ones without a
fraction, others with 15 significant digits. Workbook libraries are imported
by the executor that reads, and only then.
"""

from __future__ import annotations

import csv
import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarifold.schemas import GRID
from tarifold.session import ship


def render_cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else format(value, ".15g")
    return str(value).strip()


def _xls_sheets(path: str) -> list[str]:
    import xlrd

    return xlrd.open_workbook(path, on_demand=True).sheet_names()


def _xls_rows(path: str, sheet: str) -> Iterator[list]:
    import xlrd

    book = xlrd.open_workbook(path, on_demand=True).sheet_by_name(sheet)
    merged = {(r, c): book.cell_value(r0, c0) for r0, r1, c0, c1 in getattr(book, "merged_cells", []) for r in range(r0, r1) for c in range(c0, c1)}
    for r in range(book.nrows):
        row = book.row_values(r)
        yield [merged.get((r, c), v) if v in ("", None) else v for c, v in enumerate(row)] if merged else row


def _xlsx_sheets(path: str) -> list[str]:
    from openpyxl import load_workbook

    return load_workbook(path, read_only=True).sheetnames


def _xlsx_rows(path: str, sheet: str) -> Iterator[list]:
    from openpyxl import load_workbook

    for row in load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True):
        yield list(row)


def _csv_rows(path: str, sheet: str) -> Iterator[list]:
    with open(path, encoding="utf-8-sig", newline="") as file:
        yield from csv.reader(file)


#: Extension -> (sheets of a file, rows of a sheet). Text grids have one sheet, named "".
READERS = {".xls": (_xls_sheets, _xls_rows), ".xlsx": (_xlsx_sheets, _xlsx_rows), ".csv": (lambda path: [""], _csv_rows)}


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.sheet, self.first = options["path"], options.get("sheet"), int(options.get("firstrow", 1))
        self.fallback = options.get("fallback", "false") == "true"

    def partitions(self) -> list[SheetPartition]:
        paths = sorted(glob.glob(self.pattern, recursive=True)) if not os.path.isdir(self.pattern) else sorted(glob.glob(f"{self.pattern}/**", recursive=True))
        paths = [p for p in paths if os.path.splitext(p)[1].lower() in READERS]
        if not paths:
            raise FileNotFoundError(self.pattern)
        out = []
        for path in paths:
            names = READERS[os.path.splitext(path)[1].lower()][0](path)
            if self.fallback:
                names = [self.sheet if self.sheet in names else names[0]]
            elif self.sheet is not None and self.sheet not in names and names != [""]:
                raise ValueError(f"sheet not found: {self.sheet}, there are {names}")
            out += [SheetPartition(path, n) for n in names if self.fallback or self.sheet is None or n in (self.sheet, "")]
        return out

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        rows = READERS[os.path.splitext(partition.path)[1].lower()][1](partition.path, partition.sheet)
        for number, row in enumerate(rows, 1):
            if number >= self.first:
                yield (partition.path, partition.sheet, number, [render_cell(v) for v in row])


class GridSource(DataSource):
    """format("grid"): options path (file, folder or pattern), sheet, firstrow (1-based), fallback (the first sheet where the named one is missing)."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return GRID

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def read_grid(spark: SparkSession, path: str, sheet: str | None = None, first_row: int = 1, fallback: bool = False) -> DataFrame:
    ship(spark)
    spark.dataSource.register(GridSource)
    reader = spark.read.format("grid").option("firstrow", str(first_row)).option("fallback", str(fallback).lower())
    if sheet is not None:
        reader = reader.option("sheet", sheet)
    return reader.load(path)


def header_index(header: list[str]) -> dict[str, int]:
    """Header text -> 1-based position; of equal headers the last wins."""
    return {h.strip(): i for i, h in enumerate(header, 1) if h and h.strip()}
