"""Workbooks as sparse cell rows: XLSX, XLSM, ODS and flat ODS."""

from __future__ import annotations

import datetime as dt
import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = ("file {file}, sheet string, sheet_idx int, hidden boolean, kind string, row int, col int, value string, "
               "text string, type string, formula string, link string, error string")
CELL_COLUMNS = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
# Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


@functools.lru_cache(4096)
def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _tag(node) -> str:
    return _local(node.tag)


def _attr(node, name: str, default=None):
    for key, value in node.attrib.items():
        if _local(key) == name:
            return value
    return default


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _tag(t) == "t")


def _place(ref: str) -> tuple[int, int]:
    """``B3`` to 0-based (row, column)."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for letter in letters.upper():
        col = col * 26 + ord(letter) - 64
    return int(digits) - 1, col - 1


def _date_styles(package: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in package.namelist():
        return set()
    root = ElementTree.fromstring(package.read("xl/styles.xml"))
    own = {int(_attr(n, "numFmtId")): _attr(n, "formatCode", "") for n in root.iter() if _tag(n) == "numFmt"}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)}
    formats = next((n for n in root if _tag(n) == "cellXfs"), [])
    return {i for i, n in enumerate(formats) if int(_attr(n, "numFmtId", "0")) in dates}


def _serial_date(value: str, date1904: bool) -> str:
    start = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
    return (start + dt.timedelta(days=round(float(value) * 86_400_000) / 86_400_000)).isoformat(timespec="milliseconds") + "Z"


def _xlsx(package: zipfile.ZipFile) -> Iterator[tuple]:
    book = ElementTree.fromstring(package.read("xl/workbook.xml"))
    names = set(package.namelist())

    def relations(part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        path = f"{folder}/_rels/{name}.rels"
        if path not in names:
            return {}
        found = ElementTree.fromstring(package.read(path))
        return {_attr(r, "Id"): _attr(r, "Target") for r in found}

    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = [_text(si) for si in ElementTree.fromstring(package.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
    dates = _date_styles(package)
    date1904 = any(_attr(n, "date1904") in ("1", "true") for n in book.iter() if _tag(n) == "workbookPr")
    parts = relations("xl/workbook.xml")
    for index, sheet in enumerate(n for n in book.iter() if _tag(n) == "sheet"):
        name, hidden = _attr(sheet, "name"), _attr(sheet, "state", "visible") != "visible"
        head = (name, index, hidden)
        yield (*head, "sheet", None, None, None, None, None, None, None)
        target = parts.get(_attr(sheet, "id"), "")
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        if part in names:
            yield from _xlsx_sheet(package.read(part), head, shared, dates, date1904, relations(part))


def _xlsx_sheet(xml: bytes, head: tuple, shared: list[str], dates: set[int], date1904: bool, rels: dict) -> Iterator[tuple]:
    root = ElementTree.fromstring(xml)
    found = {"hyperlink": [], "c": [], "mergeCell": []}
    for node in root.iter():
        if (tag := _tag(node)) in found:
            found[tag].append(node)
    links = {_attr(n, "ref"): rels.get(_attr(n, "id")) or _attr(n, "location") for n in found["hyperlink"]}
    for cell in found["c"]:
        ref, kind = _attr(cell, "r"), _attr(cell, "t", "n")
        raw = next((n.text or "" for n in cell if _tag(n) == "v"), None)
        formula = next((n.text or "" for n in cell if _tag(n) == "f"), None)
        if kind == "inlineStr":
            raw, kind = _text(cell), "s"
        elif kind == "s" and raw is not None:
            raw = shared[int(raw)]
        elif kind == "str":
            kind = "s"
        elif kind == "b":
            raw = "TRUE" if raw == "1" else "FALSE"
        elif kind == "n" and raw is not None and int(_attr(cell, "s", "0")) in dates:
            raw, kind = _serial_date(raw, date1904), "d"
        if raw is None and formula is None and ref not in links:
            continue
        row, col = _place(ref)
        yield (*head, "cell", row, col, raw, raw, kind, formula, links.get(ref))
    for merge in found["mergeCell"]:
        yield (*head, "merge", None, None, _attr(merge, "ref"), None, None, None, None)


def _ods(xml: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(xml)
    hidden_styles = {_attr(style, "name") for style in root.iter() if _tag(style) == "style" and any(
        _tag(p) == "table-properties" and _attr(p, "display") == "false" for p in style)}
    for index, table in enumerate(n for n in root.iter() if _tag(n) == "table"):
        head = (_attr(table, "name"), index, _attr(table, "style-name") in hidden_styles)
        yield (*head, "sheet", None, None, None, None, None, None, None)
        row = 0
        for line in (n for n in table.iter() if _tag(n) == "table-row"):
            repeat_rows = int(_attr(line, "number-rows-repeated", "1"))
            cells, col = [], 0
            for cell in (n for n in line if _tag(n) in ("table-cell", "covered-table-cell")):
                repeat = int(_attr(cell, "number-columns-repeated", "1"))
                kind = _attr(cell, "value-type")
                paragraphs = ["".join(p.itertext()) for p in cell if _tag(p) == "p"]
                text = "\n".join(paragraphs) if paragraphs else None
                value = {"float": _attr(cell, "value"), "currency": _attr(cell, "value"), "percentage": _attr(cell, "value"),
                         "date": _attr(cell, "date-value"), "boolean": (_attr(cell, "boolean-value") or "").upper()}.get(kind, text)
                formula = _attr(cell, "formula")
                formula = re.sub(r"^of:=|^oooc:=|^=", "", formula) if formula else None
                link = next((_attr(a, "href") for a in cell.iter() if _tag(a) == "a"), None)
                if value is not None or formula is not None:
                    code = {"float": "n", "currency": "n", "percentage": "n", "date": "d", "boolean": "b"}.get(kind, "s")
                    cells += [(col + i, value, text if text is not None else value, code, formula, link) for i in range(repeat)]
                wide, tall = int(_attr(cell, "number-columns-spanned", "1")), int(_attr(cell, "number-rows-spanned", "1"))
                if wide > 1 or tall > 1:
                    yield (*head, "merge", row, col, f"{tall}x{wide}", None, None, None, None)
                col += repeat
            for i in range(repeat_rows if cells else 0):
                for place, *rest in cells:
                    yield (*head, "cell", row + i, place, *rest)
            row += repeat_rows


def _cells(data: bytes) -> Iterator[tuple]:
    if data[:2] != b"PK":
        yield from _ods(data)
        return
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        names = package.namelist()
        if "xl/workbook.xml" in names:
            yield from _xlsx(package)
        elif "content.xml" in names:
            yield from _ods(package.read("content.xml"))
        else:
            raise ValueError("workbook kind is not supported")


def workbook_cells(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Sparse cells of workbook files, one row each, plus one ``sheet`` row per sheet and ``merge`` rows.

    A file that cannot be read gives one row with ``error``.
    """
    schema = CELL_SCHEMA.format(file=files.schema[file].dataType.simpleString())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for name, data in zip(batch["f"], batch["c"]):
                try:
                    for cell in _cells(bytes(data)):
                        rows.append((name, *cell, None))
                        if len(rows) >= 50_000:
                            yield frame(rows)
                            rows = []
                except Exception as error:  # one broken workbook must not end the job
                    rows.append((name, *(None,) * 11, f"SPREADSHEET_CORRUPT: {error}"))
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=CELL_COLUMNS)
        for column in ("sheet_idx", "row", "col"):
            out[column] = out[column].astype("Int64")
        out["hidden"] = out["hidden"].astype("boolean")
        return out

    return files.select(F.col(file).alias("f"), F.col(content).alias("c")).mapInPandas(decode, schema)


def read_workbook_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return workbook_cells(files)
