"""JSON rows to tables and back: row shape, column order, cell text, column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.tables import once
from tablemill.functions.text import js_number, js_trim

MAX_COLUMNS = 2000
MAX_SAFE_INTEGER = 2**53 - 1


def is_json(text: Column) -> Column:
    """Exactly one JSON value and nothing after it.

    Spark's parsers stop at the end of the first value, so the text is put inside an object that must close with a
    key the text cannot contain by chance.
    """
    mark = F.md5(text)
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":1}'))
    return F.coalesce(
        F.try_parse_json(wrapped).isNotNull() & (F.json_object_keys(wrapped) == F.array(F.lit("v"), mark)), F.lit(False))


def normalize_rows(raw: DataFrame, json_col: str, index_col: str) -> DataFrame:
    """Add ``row_json``: objects stay; a primitive, null or array becomes ``{"value": …, "row_index": n}``.

    ``index_col`` holds the 0-based position among the non-blank rows. Text that is no JSON value gives null.
    """
    trimmed = once(raw, __t=js_trim(F.col(json_col)))
    text = F.col("__t")
    wrapped = F.concat(F.lit('{"value":'), text, F.lit(',"row_index":'), F.col(index_col).cast("string"), F.lit("}"))
    return once(trimmed, row_json=F.when(is_json(text), F.when(text.startswith("{"), text).otherwise(wrapped))).drop("__t")


def _ordered_keys(row_json: Column) -> Column:
    """Keys of an object as ECMAScript lists them: array indexes ascending, then the others as written."""
    keys = F.array_distinct(F.json_object_keys(row_json))
    index = r"^(?:0|[1-9]\d{0,9})$"

    def is_index(k: Column) -> Column:
        return k.rlike(index) & (F.coalesce(k.try_cast("bigint"), F.lit(-1)) < 2**32 - 1)

    numbers = F.transform(F.array_sort(F.transform(F.filter(keys, is_index), lambda k: k.cast("bigint"))),
                          lambda n: n.cast("string"))
    return F.concat(numbers, F.filter(keys, lambda k: ~is_index(k)))


def key_positions(rows: DataFrame, index_col: str = "row_index") -> DataFrame:
    """``(key, first_row, first_pos)``: where each key is seen first."""
    return (
        rows.select(F.col(index_col).alias("r"), F.posexplode(_ordered_keys(F.col("row_json"))).alias("p", "key"))
        .groupBy("key").agg(F.min(F.struct("r", "p")).alias("at"))
        .select("key", F.col("at.r").alias("first_row"), F.col("at.p").alias("first_pos"))
    )


def ordered_columns(rows: DataFrame, max_columns: int = MAX_COLUMNS, index_col: str = "row_index") -> list[str]:
    """Union of the keys in first-seen order. Only the key list, bounded by ``max_columns``, reaches the driver."""
    found = key_positions(rows, index_col).orderBy("first_row", "first_pos").limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError("DATA_COLUMN_LIMIT: JSON input contains too many distinct columns.")
    return [r["key"] for r in found] or ["value"]


# Only numbers with a fraction, an exponent or many digits may print differently from how they are written.
ODD = r"[0-9](?:\.[0-9]|[eE])|[0-9]{16}"
TEXTS, VALUES = T.MapType(T.StringType(), T.StringType()), T.MapType(T.StringType(), T.VariantType())


def _printed(raw: Column, value: Column) -> Column:
    """The text of a cell from its own text and its typed value."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    renders = raw.rlike(r"^-?[0-9](?:.*[.eE]|[0-9]{15})") & kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT|BIGINT)") & (
        (kind != "BIGINT") | (F.abs(number) > MAX_SAFE_INTEGER))
    return F.when(renders, js_number(number)).otherwise(raw)


def rows_to_table(rows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One text column per key, each value as the text its CSV cell would hold (null for null and for missing)."""
    parsed = once(
        rows.select(*keep, "row_json"), __text=F.from_json("row_json", TEXTS),
        __typed=F.when(F.col("row_json").rlike(ODD), F.from_json("row_json", VALUES)))
    return parsed.select(*keep, *[_printed(F.col("__text")[c], F.col("__typed")[c]).alias(c) for c in columns])


def _cell_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return js_number(col.cast("double"))
    return col.cast("string")


def csv_cell(col: Column, dtype: T.DataType | None = None, delimiter: str = ",") -> Column:
    """CSV cell: null is empty, nested values are compact JSON; quoted when it holds a quote, CR, LF or delimiter."""
    text = F.coalesce(_cell_text(col, dtype or T.StringType()), F.lit(""))
    needs = text.rlike(r'["\r\n]') | F.contains(text, F.lit(delimiter))
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    """A whole row as one CSV line."""
    return F.concat_ws(delimiter, *[csv_cell(F.col(f"`{f.name}`"), f.dataType, delimiter) for f in df.schema.fields])


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _export(col: Column, dtype: T.DataType, bigint_as_string: bool) -> Column:
    def inner(c: Column, t: T.DataType) -> Column:
        return _export(c, t, bigint_as_string)

    if isinstance(dtype, T.LongType) and bigint_as_string:
        return col.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        # ISO text in UTC (the session zone)
        return F.date_format(col.cast("timestamp"), ISO)
    if isinstance(dtype, T.BinaryType):
        n = F.octet_length(col)
        return F.when(n == 0, F.array().cast("array<int>")).when(
            n > 0, F.transform(F.sequence(F.lit(1), n),
                               lambda i: F.conv(F.hex(F.substring(col, i, 1)), 16, 10).cast("int")))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda v: inner(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: inner(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[inner(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return col


def json_export_values(df: DataFrame, bigint_as_string: bool = True) -> DataFrame:
    """Values as they leave for JSON: bigint as text, times as ISO text in UTC, bytes as arrays of numbers."""
    return df.select(*[_export(F.col(f"`{f.name}`"), f.dataType, bigint_as_string).alias(f.name)
                       for f in df.schema.fields])


def infer_affinity(rows: DataFrame, sample: int | None = None, index_col: str = "row_index") -> DataFrame:
    """``(key, affinity)`` of every key, typed by all rows, or by the first ``sample`` rows where that is asked for.

    TEXT beats BLOB beats REAL beats INTEGER; booleans and whole numbers are INTEGER; all null is TEXT.
    """
    cells = (
        rows.select(F.col(index_col).alias("r"),
                F.explode(F.from_json("row_json", T.MapType(T.StringType(), T.VariantType()))).alias("key", "v"))
        .select("r", "key", "v", F.schema_of_variant("v").alias("kind"))
    )
    number = F.try_variant_get("v", "$", "double")
    numeric = F.col("kind").rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
    sampled = F.lit(True) if sample is None else F.col("r") < sample
    text = sampled & ~numeric & ~F.col("kind").isin("VOID", "BOOLEAN", "BINARY")
    flags = cells.groupBy("key").agg(
        F.bool_or(text).alias("text"),
        F.bool_or(sampled & (F.col("kind") == "BINARY")).alias("blob"),
        F.bool_or(sampled & numeric & (number % 1 != 0)).alias("real"),
        F.bool_or(sampled & ((F.col("kind") == "BOOLEAN") | numeric)).alias("whole"),
    )
    return flags.select("key", F.when(F.col("text"), "TEXT").when(F.col("blob"), "BLOB").when(F.col("real"), "REAL")
                        .when(F.col("whole"), "INTEGER").otherwise("TEXT").alias("affinity"))


def coerce_cells(df: DataFrame) -> DataFrame:
    """Cells for a flat table: booleans become 1 and 0, nested values JSON text, nulls stay."""
    def cell(f: T.StructField) -> Column:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return col.cast("int")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return F.to_json(col, {"ignoreNullFields": "false"})
        return col
    return df.select(*[cell(f).alias(f.name) for f in df.schema.fields])


# Shapes of text values, tried in this order.
SHAPES = [
    ("bigint", r"^[+-]?(?:0|[1-9]\d*)$"),
    ("double", r"^[+-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"),
    ("boolean", r"(?i)^(?:true|false)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp_ntz", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?$"),
]
# A column takes the first type that covers all shapes seen in it.
COVERS = [("bigint", {"bigint"}), ("double", {"bigint", "double"}), ("boolean", {"boolean"}), ("date", {"date"}),
          ("timestamp_ntz", {"date", "timestamp_ntz"})]


def _shape(value: Column) -> Column:
    """A bit for the shape of a text value; none for null and empty text, the last one for plain text."""
    value = F.nullif(value, F.lit(""))
    # every shape but plain text starts with one of these
    bit = F.when(value.isNull(), 0).when(~F.substring(value, 1, 1).rlike(r"[0-9+\-.tTfF]"), 1 << len(SHAPES))
    for i, (dtype, pattern) in enumerate(SHAPES):
        bit = bit.when(value.rlike(pattern) & value.try_cast(dtype).isNotNull(), 1 << i)
    return bit.otherwise(1 << len(SHAPES))


def _covering(bits: int) -> str:
    """The narrowest type for the union of some shapes."""
    seen = {dtype for j, (dtype, _) in enumerate(SHAPES) if bits >> j & 1}
    plain = bits >> len(SHAPES) & 1
    return next((t for t, covered in COVERS if seen and not plain and seen <= covered), "string")


def text_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of every text column, from one pass that returns a single row with a bit set per column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    row = df.agg(*[F.bit_or(_shape(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {name: _covering(row[f"c{i}"] or 0) for i, name in enumerate(names)}


PLACES = 1 << 16  # keys of one row that are told apart by place; more are beyond any limit of columns


def infer_columns(rows: DataFrame, max_columns: int = MAX_COLUMNS, index_col: str = "row_index") -> dict[str, str]:
    """Columns in first-seen order with the narrowest type of their values, in one pass.

    Both are small values that merge in any order: the least place of a key, and the union of its values' shapes. They are
    folded on the map side, so one row per task and key is shuffled, and one row per key reaches the driver.
    """
    # the typed values are parsed for rows with numbers that may print differently
    odd = F.col("row_json").rlike(ODD)
    texts = F.from_json("row_json", TEXTS)
    cells = F.when(odd, F.map_zip_with(texts, F.from_json("row_json", VALUES), lambda k, s, v: _printed(s, v))).otherwise(texts)
    seen = rows.select(F.col(index_col).alias("r"), F.posexplode(cells).alias("p", "key", "cell")).groupBy("key").agg(
        F.min(F.col("r") * PLACES + F.least(F.col("p"), F.lit(PLACES - 1))).alias("place"), F.bit_or(_shape(F.col("cell"))).alias("bits"))
    found = seen.limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError("DATA_COLUMN_LIMIT: JSON input contains too many distinct columns.")

    def order(row) -> tuple:
        key, (r, p) = row["key"], divmod(row["place"], PLACES)
        # array indexes come first and ascending, as ECMAScript lists them
        index = key.isascii() and key.isdigit() and str(int(key)) == key and int(key) < 2**32 - 1
        return (r, 0, int(key)) if index else (r, 1, p)

    return {r["key"]: _covering(r["bits"]) for r in sorted(found, key=order)} or {"value": "string"}


def retype_text(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns re-read by value: numbers, booleans, dates, timestamps; empty text becomes null."""
    types = text_types(df) if types is None else types
    return df.select(*[
        F.nullif(F.col(f"`{c}`"), F.lit("")).cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
        for c in df.columns])


def assert_max_rows(df: DataFrame, n: int, code: str = "SQLITE_EXPORT_ROW_LIMIT") -> DataFrame:
    """The frame itself, or an error when it has more than ``n`` rows. Counting stops after ``n + 1``."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"{code}: Query result exceeds the guarded row limit of {n}.")
    return df
