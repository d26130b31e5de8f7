"""Spreadsheets as tables: cells and sheets of XLSX files, read with zip and XML only.

A file is one task's unit and is read as a whole; its cells leave the task as rows.  Only cells with content are rows, in order of row
and column.  A formula is kept as its text and has no displayed value.  Hidden column groups count column by column.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "document_id string, sheet string, sheet_index int, row int, col int, coordinate string, value_text string, displayed string, data_type string, is_formula boolean"
SHEETS = "document_id string, sheet string, sheet_index int, state string, merged_ranges array<string>, hidden_rows array<int>, hidden_columns array<string>, code string"
#: Numbers of built-in formats that show days or times.
DAY_FORMATS = {*range(14, 23), *range(45, 48)}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    """All text of a shared or inline string, without phonetic notes."""
    return "".join(t.text or "" for r in node for t in ([r] if _name(r.tag) == "t" else r if _name(r.tag) == "r" else []) if _name(t.tag) == "t")


def letters(number: int) -> str:
    out = ""
    while number:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def place(coordinate: str) -> tuple[int, int]:
    """(row, column) of an A1 coordinate."""
    m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", coordinate)
    col = 0
    for ch in m[1]:
        col = 26 * col + ord(ch) - 64
    return int(m[2]), col


def bounds(span: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of A1:C2 or of one cell."""
    first, _, last = span.partition(":")
    (top, left), (bottom, right) = place(first), place(last or first)
    return top, left, bottom, right


#: What a file that is no workbook may raise.
UNREADABLE = (zipfile.BadZipFile, KeyError, ValueError, IndexError, AttributeError, TypeError, OSError, EOFError, StopIteration, ElementTree.ParseError)


def workbook(source: BinaryIO) -> Iterator[tuple[dict, list[dict]]]:
    """(sheet, its cells) of a file."""
    with zipfile.ZipFile(source) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        shared = [_text(x) for x in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        days = []
        if "xl/styles.xml" in names:
            own: dict[int, str] = {}
            for node in parse("xl/styles.xml"):
                if _name(node.tag) == "numFmts":
                    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in node}
                if _name(node.tag) == "cellXfs":
                    ids = [int(x.get("numFmtId", 0)) for x in node]
                    days = [i in DAY_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*]|General', "", own.get(i, "")))) for i in ids]
        links = {x.get("Id"): x.get("Target") for x in parse("xl/_rels/workbook.xml.rels")}
        book = parse("xl/workbook.xml")
        start = datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in book if _name(x.tag) == "workbookPr") else datetime(1899, 12, 30)
        for index, node in enumerate(x for part in book if _name(part.tag) == "sheets" for x in part):
            target = links[next(v for k, v in node.items() if _name(k) == "id")]
            sheet = {"sheet": node.get("name"), "sheet_index": index, "state": node.get("state", "visible"), "merged_ranges": [], "hidden_rows": [], "hidden_columns": []}
            cells = []
            row = 0
            for x in parse(posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]).iter():
                tag = _name(x.tag)
                if tag == "col" and x.get("hidden") in ("1", "true"):
                    sheet["hidden_columns"] += [letters(k) for k in range(int(x.get("min")), int(x.get("max")) + 1)]
                elif tag == "mergeCell":
                    sheet["merged_ranges"].append(x.get("ref"))
                elif tag == "row":
                    row = int(x.get("r", row + 1))
                    col = 0
                    if x.get("hidden") in ("1", "true"):
                        sheet["hidden_rows"].append(row)
                elif tag == "c":
                    at = x.get("r") or f"{letters(col + 1)}{row}"
                    r, col = place(at)
                    cell = _cell(x, shared, days, start)
                    if cell:
                        cells.append({"row": r, "col": col, "coordinate": at, **cell})
            sheet["hidden_columns"] = sorted(set(sheet["hidden_columns"]), key=lambda c: (len(c), c))
            yield sheet, sorted(cells, key=lambda c: (c["row"], c["col"]))


def _cell(x: ElementTree.Element, shared: list[str], days: list[bool], start: datetime) -> dict | None:
    kind, parts = x.get("t", "n"), {_name(p.tag): p for p in x}
    if "f" in parts:
        return {"value_text": "=" + (parts["f"].text or ""), "displayed": None, "data_type": "f", "is_formula": True}
    text = _text(parts["is"]) if kind == "inlineStr" and "is" in parts else parts["v"].text if "v" in parts else None
    if text is None:
        return None
    if kind == "s":
        text = shared[int(text)]
    elif kind == "b":
        text = "true" if text == "1" else "false"
    elif kind == "n" and int(x.get("s", 0)) < len(days) and days[int(x.get("s", 0))]:
        moment = start + timedelta(days=float(text))
        text, kind = moment.isoformat(), "d"
    kind = {"inlineStr": "s", "str": "s"}.get(kind, kind)
    return {"value_text": text, "displayed": text, "data_type": kind, "is_formula": False}


def _run(what: str, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for document_id, content in zip(frame.document_id, frame.content, strict=True):
                rows = []
                try:
                    for sheet, cells in workbook(io.BytesIO(content)):
                        rows += [{"document_id": document_id, "code": None, **sheet}] if what == "sheets" else [{"document_id": document_id, "sheet": sheet["sheet"], "sheet_index": sheet["sheet_index"], **c} for c in cells]
                except UNREADABLE:
                    rows = [{"document_id": document_id, "code": "FILE_CORRUPTED"}] if what == "sheets" else []
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda f: f.notna(), None)

    return run


def cells(files: DataFrame) -> DataFrame:
    """The cells of files (document_id, content); a file that can't be read has none."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    return files.select("document_id", "content").where("content is not null").mapInPandas(_run("cells", names), CELLS)


def sheets(files: DataFrame) -> DataFrame:
    """The sheets of files (document_id, content); a file that can't be read has one row with a code."""
    names = [c.split()[0] for c in SHEETS.split(", ")]
    return files.select("document_id", "content").where("content is not null").mapInPandas(_run("sheets", names), SHEETS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, content): XLSX files below a folder, named by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return found.select(F.col("path").alias("document_id"), "content")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as text columns: nothing is guessed, rows of another shape fail."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"')
