"""Sheets of sparse cells: choice, tables, formulas, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.tables import once
from tablemill.functions.text import count_matches, xml_value
from tablemill.operators.formats import utf8

ONE_TABLE = ["parquet", "arrow", "sqlite", "jsonl"]


def check_sheet_policy(policy: str, target: str) -> None:
    """``all`` sheets cannot go into a target that holds one table."""
    if policy == "all" and target in ONE_TABLE:
        raise ValueError("SHEET_POLICY_INVALID: This target represents one logical table. Choose First sheet or Selected "
                         "sheet instead of All sheets.")


def choose_sheets(cells: DataFrame, policy: str = "first", selected: str | None = None) -> DataFrame:
    """Rows of the first sheet, of the named one (the first where a file has none of that name), or of all.

    ``sheet_idx`` is the 0-based place of the sheet in its workbook.
    """
    if policy == "all":
        return cells
    if policy == "first" or not selected:
        return cells.where(F.col("sheet_idx") == 0)
    named = cells.groupBy("file").agg(F.coalesce(
        F.min(F.when(F.col("sheet") == selected, F.col("sheet_idx"))), F.lit(0)).alias("__idx"))
    return cells.join(named, "file").where(F.col("sheet_idx") == F.col("__idx")).drop("__idx")


def formula_mode(cells: DataFrame, mode: str) -> DataFrame:
    """``values`` drops the expressions and keeps the cached values; ``preserve`` keeps them as ``=…`` text."""
    expression = F.when(F.col("formula").isNotNull(), F.concat(F.lit("="), F.col("formula")))
    kept = expression if mode == "preserve" else F.lit(None).cast("string")
    return cells.withColumn("formula", kept)


def cells_to_table(cells: DataFrame, columns: Sequence[str | int], header: bool = True, value: str = "value",
                   keys: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """``(keys, row, columns…)``: one row per sheet row, null where a cell is missing.

    With ``header`` the first row of each sheet names the columns (repeats get ``_1``, ``_2``, blanks ``__EMPTY``) and
    ``columns`` lists the wanted names; without it ``columns`` lists positions.
    """
    keys = list(keys)
    body = cells.where(F.col("row").isNotNull())
    if "kind" in cells.columns:
        body = body.where(F.col("kind") == "cell")
    if not header:
        picked = [F.max(F.when(F.col("col") == c, F.col(value))).alias(f"_{c}") for c in columns]
        return body.groupBy(*keys, "row").agg(*picked)
    # a sheet row has at most 16,384 cells; rows and heads share one shuffle
    rows = body.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", value))).alias("__m"))
    heads = rows.groupBy(*keys).agg(F.min_by("__m", "row").alias("__h"), F.min("row").alias("__head"))
    cells_of = F.transform(F.array_sort(F.map_entries("__h")), lambda e: F.struct(
        e["key"].alias("col"), F.coalesce(F.nullif(e["value"], F.lit("")), F.lit("__EMPTY")).alias("name")))
    listed = once(heads, __e=cells_of)

    def unique(e: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice("__e", F.lit(1), i), lambda x: x["name"] == e["name"]))
        return F.struct(F.when(n == 0, e["name"]).otherwise(F.concat_ws("_", e["name"], n.cast("string"))).alias("name"),
                        e["col"].alias("col"))

    names = once(listed.select(*keys, "__head", "__e"), __cols=F.map_from_entries(F.transform("__e", unique)))
    # a row per sheet, of a size no estimate knows: never broadcast
    joined = rows.join(names.select(*keys, "__head", "__cols").hint("merge"), keys).where(F.col("row") > F.col("__head"))
    return joined.select(*keys, "row", *[
        F.try_element_at("__m", F.try_element_at("__cols", F.lit(c))).alias(str(c)) for c in columns])


def _column_letters(col: Column) -> Column:
    """0-based column to letters (up to three, the width of a sheet)."""
    def letter(n: Column) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), F.lit(1))

    high, mid = F.floor((col - 702) / 676), F.floor((col - 26) / 26)
    return F.concat(F.when(col >= 702, letter(high)).otherwise(""), F.when(col >= 26, letter(mid)).otherwise(""), letter(col))


def inspect_sheets(cells: DataFrame) -> DataFrame:
    """Per sheet: used range, rows, columns, cells, formulas, hyperlinks, merges, hidden."""
    cell = F.col("kind") == "cell"
    grouped = cells.where(F.col("error").isNull()).groupBy("file", "sheet", "sheet_idx").agg(
        F.bool_or("hidden").alias("hidden"), F.min(F.when(cell, F.col("row"))).alias("r0"),
        F.max(F.when(cell, F.col("row"))).alias("r1"), F.min(F.when(cell, F.col("col"))).alias("c0"),
        F.max(F.when(cell, F.col("col"))).alias("c1"), F.count_if(cell).alias("cells"),
        F.count_if(cell & F.col("formula").isNotNull()).alias("formulas"),
        F.count_if(cell & F.col("link").isNotNull()).alias("hyperlinks"), F.count_if(F.col("kind") == "merge").alias("merges"))
    corner = F.concat(_column_letters(F.col("c0")), (F.col("r0") + 1).cast("string"))
    last = F.concat(_column_letters(F.col("c1")), (F.col("r1") + 1).cast("string"))
    return grouped.select(
        "file", "sheet", "sheet_idx", "hidden", F.when(corner == last, corner).otherwise(F.concat(corner, F.lit(":"), last))
        .alias("range"), (F.col("r1") - F.col("r0") + 1).alias("rows"), (F.col("c1") - F.col("c0") + 1).alias("columns"),
        "cells", "formulas", "hyperlinks", "merges")


WORKBOOK_MEMBERS = [r"xl/workbook\.xml", r"docProps/(?:core|app)\.xml", r"meta\.xml"]
MACROS = "The workbook holds macros; they are ignored."
FORMULAS = "Formulas are kept as text; their stored results are used."


def inspect_workbooks(cells: DataFrame, members: DataFrame, archive: str = "archive_id") -> DataFrame:
    """Per workbook: sheets, named ranges, macros, date system, author, title, company, warnings."""
    sheets = inspect_sheets(cells).groupBy("file").agg(
        F.count(F.lit(1)).alias("sheets"), F.sum("formulas").alias("formulas"))
    text, path = utf8(F.col("content")), F.col("path")
    facts = members.where("error IS NULL").groupBy(F.col(archive).alias("file")).agg(
        F.sum(F.when(path == "xl/workbook.xml", count_matches(text, r"<(?:\w+:)?definedName\b"))).alias("named_ranges"),
        F.bool_or(path.rlike(r"(?i)xl/vbaProject\.bin$")).alias("macros"),
        F.bool_or(F.when(path == "xl/workbook.xml", text.rlike(r"""date1904=["'](?:1|true)["']"""))).alias("date1904"),
        F.max(F.when(path == "docProps/core.xml", xml_value(text, "dc:creator"))
              .when(path == "meta.xml", xml_value(text, "meta:initial-creator"))).alias("author"),
        F.max(F.when(path.isin("docProps/core.xml", "meta.xml"), xml_value(text, "dc:title"))).alias("title"),
        F.max(F.when(path == "docProps/app.xml", xml_value(text, "Company"))).alias("company"))
    joined = sheets.join(facts.hint("merge"), "file", "left").na.fill(0, ["named_ranges"]).na.fill(False, ["macros", "date1904"])
    return joined.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("macros"), MACROS), F.when(F.col("formulas") > 0, FORMULAS)))).drop("formulas")
