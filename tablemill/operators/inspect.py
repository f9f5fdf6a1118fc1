"""Schemas, counts, previews, catalogues and the profiles of texts, pages and images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import JS_SPACE, count_matches, js_trim, unix_lines
from tablemill.operators.jsonbridge import json_export_values

# Names of the types as the embedded SQL engine prints them.
TYPE_NAMES = {
    "byte": "TINYINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "FLOAT",
    "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "binary": "BLOB", "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "variant": "JSON",
}


def sql_type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return sql_type_name(dtype.elementType) + "[]"
    if isinstance(dtype, T.MapType):
        return f"MAP({sql_type_name(dtype.keyType)}, {sql_type_name(dtype.valueType)})"
    if isinstance(dtype, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {sql_type_name(f.dataType)}" for f in dtype.fields) + ")"
    return TYPE_NAMES.get(dtype.typeName(), dtype.typeName().upper())


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column: ``position, name, type, nullable``. Reads no data."""
    rows = [(i, f.name, sql_type_name(f.dataType), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def preview(df: DataFrame, order_by: Sequence[str | Column], rows: int = 20, cols: int = 30) -> DataFrame:
    """The first rows in a stated order, the first columns, values as they leave for JSON."""
    return json_export_values(df.orderBy(*order_by).limit(rows).select(*df.columns[:cols]))


def inspect_database(tables: Mapping[str, DataFrame], cap: int | None = None) -> DataFrame:
    """Long catalogue over named tables in name order: one row per column, with the row count of its table.

    All tables are listed, or the first ``cap``; ``warning`` says so when that is reached.
    """
    names = sorted(tables)[:cap]
    if not names:
        raise ValueError("SQLITE_TABLE_REQUIRED: Database contains no user table.")
    warning = f"Only the first {cap} tables/views are shown." if cap is not None and len(names) >= cap else None
    counts = reduce(DataFrame.unionByName, [
        tables[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names])
    columns = [(n, i, f.name, sql_type_name(f.dataType), f.nullable)
               for n in names for i, f in enumerate(tables[n].schema.fields)]
    spark = tables[names[0]].sparkSession
    schema = "table_name string, position int, column_name string, column_type string, nullable boolean"
    return (
        # one row per catalogue column: the size is that of the schemas, not of the data
        counts.join(F.broadcast(spark.createDataFrame(columns, schema)), "table_name")
        .withColumn("warning", F.lit(warning).cast("string"))
    )


# What is counted in a text document of each format.
EXTERNAL = r"(?:https?:|file:|ftp:)"
TEXT_PATTERNS: dict[str, dict[str, str]] = {
    "html-doc": {
        "headings": r"(?i)<h[1-6](?:\s|>)",
        "tables": r"(?i)<table(?:\s|>)",
        "images": r"(?i)<img(?:\s|>)",
        "external_links": r"""(?i)(?:src|href)\s*=\s*["']""" + EXTERNAL,
    },
    "markdown": {
        "headings": r"(?m)^#{1,6}\s+.+$",
        "tables": r"(?m)^\s*\|.*\|\s*$",
        "images": r"!\[[^\]]*\]\([^)]+\)",
        "external_links": r"\]\(" + EXTERNAL + r"[^)]+\)",
    },
    "latex": {
        "headings": r"\\(?:part|chapter|section|subsection|subsubsection)\*?\s*\{",
        "tables": r"\\begin\{(?:tabular|table)\}",
        "images": r"\\includegraphics(?:\[[^\]]*\])?\{",
        "equations": r"\\begin\{(?:equation|align|math|displaymath)\}",
        "external_links": r"\\(?:url|href)\s*\{" + EXTERNAL,
    },
    "typst": {
        "headings": r"(?m)^=+\s+.+$",
        "tables": r"#table\s*\(",
        "images": r"#image\s*\(",
    },
    "txt": {},
    "rtf": {},
}
TEXT_COUNTERS = ["headings", "tables", "images", "equations", "external_links"]


def inspect_text(df: DataFrame, text_col: str, format_col: str) -> DataFrame:
    """Add ``paragraphs``, the counters of the row's format (null where it has none), ``title`` and ``warning``."""
    text = F.col(text_col)
    blocks = F.split(unix_lines(text), rf"\n{JS_SPACE}*\n")
    out = df.withColumn("paragraphs", F.size(F.filter(blocks, lambda b: js_trim(b) != "")).cast("bigint"))
    for counter in TEXT_COUNTERS:
        value = F.lit(None).cast("bigint")
        for fmt, patterns in TEXT_PATTERNS.items():
            if counter in patterns:
                n = count_matches(text, patterns[counter])
                if (fmt, counter) == ("markdown", "tables"):
                    n = F.when(n > 1, 1).otherwise(0).cast("bigint")
                value = F.when(F.col(format_col) == fmt, n).otherwise(value)
        out = out.withColumn(counter, value)
    pattern = r"(?i)<title[^>]*>([\s\S]*?)</title>"
    title = F.when(text.rlike(pattern), js_trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), "<[^>]+>", "")))
    return out.withColumn("title", F.when(F.col(format_col) == "html-doc", title)).withColumn(
        "warning",
        F.when(F.col("external_links") > 0,
               F.concat(F.col("external_links").cast("string"),
                        F.lit(" reference(s) point to other hosts and were left alone."))))


# Markers of frame headers, and markers that stand alone.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0xD8, 0xD9}


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and payload of each complete segment after the start of the image."""
    at = data.find(b"\xff", 2)
    while 0 <= at <= len(data) - 4:
        marker, length = struct.unpack_from(">BH", data, at + 1)
        end = at + 2 if marker in ALONE else at + 2 + length
        if marker not in ALONE:
            if length < 2 or end > len(data):
                return
            yield marker, data[at + 4:end]
        at = data.find(b"\xff", end)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first frame header: a precision byte, the height, the width."""
    frame = next((payload for marker, payload in _segments(data) if marker in FRAMES and len(payload) >= 5), None)
    return struct.unpack_from(">HH", frame, 1)[::-1] if frame else None


SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(SIZE)
def _jpeg_sizes(content: pd.Series) -> pd.DataFrame:
    sizes = [_jpeg_size(bytes(c)) if c is not None and c[:2] == b"\xff\xd8" else None for c in content]
    return pd.DataFrame({
        "width": pd.array([s[0] if s else None for s in sizes], dtype="Int64"),
        "height": pd.array([s[1] if s else None for s in sizes], dtype="Int64")})


def _uint(content: Column, start: int, length: int, little: bool = False) -> Column:
    """Unsigned integer at a 1-based byte position."""
    order = range(length - 1, -1, -1) if little else range(length)
    return F.conv(F.concat(*[F.hex(F.substring(content, start + i, 1)) for i in order]), 16, 10).cast("bigint")


def image_dimensions(files: DataFrame, content: str = "content", format_col: str = "format_id") -> DataFrame:
    """Add ``width, height`` from the headers of PNG, GIF and JPEG files (null for others and for cut headers)."""
    data, fmt = F.col(content), F.col(format_col)
    # only JPEG bytes cross to Python
    jpeg = files.withColumn("__jpeg", _jpeg_sizes(F.when(fmt == "jpeg", data)))
    size = F.octet_length(data)
    return jpeg.withColumn(
        "width",
        F.when((fmt == "png") & (size >= 24), _uint(data, 17, 4))
        .when((fmt == "gif") & (size >= 10), _uint(data, 7, 2, little=True))
        .when(fmt == "jpeg", F.col("__jpeg.width")),
    ).withColumn(
        "height",
        F.when((fmt == "png") & (size >= 24), _uint(data, 21, 4))
        .when((fmt == "gif") & (size >= 10), _uint(data, 9, 2, little=True))
        .when(fmt == "jpeg", F.col("__jpeg.height")),
    ).drop("__jpeg")


def image_budget(
    df: DataFrame, max_pixels: int, max_bytes: int, frames: Column | int = 1, bytes_per_pixel: int = 4
) -> DataFrame:
    """Add ``decoded_pixels, decoded_bytes, budget_error`` for rows with ``width, height``."""
    frames = frames if isinstance(frames, Column) else F.lit(frames)
    pixels = (F.col("width") * F.col("height") * frames).cast("bigint")
    return (
        df.withColumn("decoded_pixels", pixels)
        .withColumn("decoded_bytes", F.col("decoded_pixels") * max(1, bytes_per_pixel))
        .withColumn(
            "budget_error",
            F.when(F.col("decoded_pixels") > max_pixels,
                   "IMAGE_DIMENSIONS_UNSAFE: Decoded pixel count exceeds the budget.")
            .when(F.col("decoded_bytes") > max_bytes,
                  "IMAGE_MEMORY_UNSAFE: Estimated decoded image memory exceeds the budget."))
    )


SCANNED_BELOW = 5


def page_coverage(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Per document: pages, pages with and without text, characters, and whether both kinds occur."""
    chars = F.coalesce(F.char_length(js_trim(F.col(text))), F.lit(0))
    return (
        pages.withColumn("__chars", chars)
        .groupBy(doc)
        .agg(F.count(F.lit(1)).alias("pages"),
             F.count_if(F.col("__chars") >= SCANNED_BELOW).alias("text_pages"),
             F.count_if(F.col("__chars") < SCANNED_BELOW).alias("scanned_pages"),
             F.sum("__chars").cast("bigint").alias("chars"))
        .withColumn("mixed", (F.col("text_pages") > 0) & (F.col("scanned_pages") > 0))
        .withColumn("kind", F.when(F.col("mixed"), "mixed").when(F.col("text_pages") > 0, "text").otherwise("scanned"))
    )


def select_pages(pages: DataFrame, which: str = "scanned", text: str = "text") -> DataFrame:
    """All pages, or only those without searchable text."""
    if which == "all":
        return pages
    return pages.where(F.coalesce(F.char_length(js_trim(F.col(text))), F.lit(0)) < SCANNED_BELOW)
