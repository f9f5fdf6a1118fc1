"""CSV, TSV, JSON, JSON Lines, Parquet and Arrow scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablemill.functions.tables import local_table
from tablemill.functions.text import js_trim, plain_path, strip_bom
from tablemill.operators.jsonbridge import infer_columns, is_json, normalize_rows, ordered_columns, retype_text, rows_to_table
from tablemill.session import work_path
from tablemill.sources.csvrecords import csv_lines, csv_records, line_blocks
from tablemill.sources.jsonparts import array_elements, numbered

ROWS_PER_FILE = 20_000
SPLIT_OVER = 128 << 20  # bytes of a JSON document
DELIMITERS = [",", ";", "\t", "|"]


def sniff_delimiter(lines: DataFrame, value: str = "value") -> str:
    """The candidate whose count outside quotes is the most regular over all lines; comma when none occurs.

    One pass that counts; a single row per candidate reaches the driver.
    """
    return _sniff(lines, value)[0]


def _sniff(lines: DataFrame, value: str = "value") -> tuple[str, bool]:
    """The delimiter, and whether any line holds a quote."""
    quoted = F.contains(F.col(value), F.lit('"'))
    bare = lines.select(quoted.alias("quoted"), F.when(quoted, F.regexp_replace(value, r'"[^"]*(?:"|$)', "")).otherwise(
        F.col(value)).alias("outside"))
    # most lines are alike, so they are counted before the candidates are told apart
    alike = bare.groupBy("quoted", F.array(*[F.length("outside") - F.length(F.replace("outside", F.lit(c), F.lit("")))
                                             for c in DELIMITERS]).alias("widths")).agg(F.count(F.lit(1)).alias("n"))
    votes = alike.select("quoted", "n", F.posexplode("widths").alias("i", "width")).groupBy("i", "width").agg(
        F.sum("n").alias("n"), F.bool_or("quoted").alias("quoted"))
    found = votes.groupBy("i").agg(F.max(F.struct("n", "width")).alias("most"), F.bool_or("quoted").alias("quoted")).collect()
    best = min((r for r in found if r["most"]["width"] > 0), key=lambda r: (-r["most"]["n"], -r["most"]["width"], r["i"]), default=None)
    return DELIMITERS[best["i"]] if best else ",", any(r["quoted"] for r in found)


def _widen(df: DataFrame) -> DataFrame:
    """Inferred int columns become bigint."""
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _parsed(reader: DataFrameReader, records: DataFrame) -> DataFrame:
    """CSV records given as rows, by the reader that parses files."""
    spark = records.sparkSession
    strings = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(strings), spark)


PLACE = ["__path", "__block", "__row"]


def _read_records(spark: SparkSession, records: DataFrame, reader: Callable[[], DataFrameReader], header: bool,
                  schema: T.StructType | str | None, options: dict[str, str], ordered: bool) -> DataFrame:
    """The records as a table, with the place of each; ordered, they come as they lie in the files."""
    place = F.struct("block", "seq")
    firsts = records.groupBy("file").agg(F.min(place).alias("first"), F.min_by("record", place).alias("head"))
    body = records
    if header:
        body = records.join(firsts.select("file", "first"), "file").where(place > F.col("first"))
    if schema is None:
        # the first record of the first file names the columns
        head = firsts.orderBy("file").select("head").first()
        named = local_table(spark, [(head[0] if head else "",)], "record string")
        schema = _parsed(reader().options(header=header, inferSchema=True), named.unionByName(body.select("record"))).schema
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields.fields)
    place = [F.col(c).alias(n) for c, n in zip(("file", "block", "seq"), PLACE)]
    if ordered:
        body = body.orderBy("file", "block", "seq")
    return body.select(F.from_csv("record", F.lit(ddl), options).alias("r"), *place).select("r.*", *PLACE)


def read_csv(
    spark: SparkSession, path: str | list[str], delimiter: str = "auto", header: bool = True,
    schema: T.StructType | str | None = None, multiline: bool = True, place: bool = False,
) -> DataFrame:
    """CSV scan. ``auto`` finds the delimiter in a pass over the lines, and whether there are quotes; a ``schema`` saves the
    inference pass.

    Line breaks in quotes are part of a cell. Large files are split all the same: a pass over the lines looks for cells that
    go on in the next line, and where there are any, records are put together from lines (see ``csvrecords``).
    ``multiline=False`` saves that pass where no cell holds a line break. With ``place`` the file of a row and its place in it
    follow as ``__path, __block, __row``.
    """
    if delimiter == "auto":
        delimiter, quoted = _sniff(spark.read.text(path))
        multiline = multiline and quoted  # without a quote no cell goes on in the next line

    options = {"sep": delimiter, "quote": '"', "escape": '"'}

    def reader() -> DataFrameReader:
        return spark.read.options(**options, preferDate="true", timestampType="TIMESTAMP_NTZ")

    def placed(table: DataFrame) -> DataFrame:
        return table.select("*", plain_path(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.file_block_start").alias(
            "__block"), F.monotonically_increasing_id().alias("__row")) if place else table

    spark_conf = spark.conf.get("spark.sql.timestampType", "TIMESTAMP_LTZ")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    try:
        if multiline:
            lines = csv_lines(spark, path, delimiter)
            blocks = line_blocks(lines)
            if not blocks.where("opens = 1").isEmpty():
                table = _read_records(spark, csv_records(lines, blocks), reader, header, schema, options, not place)
                table = table if place else table.drop(*PLACE)
                return table if schema is not None else _widen(table)
        if schema is not None:
            return placed(reader().option("header", header).schema(schema).csv(path))
        return placed(_widen(reader().options(header=header, inferSchema=True).csv(path)))
    finally:
        spark.conf.set("spark.sql.timestampType", spark_conf)


def read_tsv(spark: SparkSession, path: str | list[str], header: bool = True,
             schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    return read_csv(spark, path, "\t", header, schema, multiline)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def json_line_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, row_index, json)``: the non-blank lines with their 0-based position in each file.

    The position is the one inside the file block a task reads plus the lines of the blocks before it, so a large
    file stays split and nothing is sorted.
    """
    lines = (
        spark.read.text(path)
        .select("value", plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("json", js_trim(F.when(F.col("block") == 0, strip_bom(F.col("value"))).otherwise(F.col("value"))))
        .where(F.col("json") != "")
        .select("file", "block", "json", F.monotonically_increasing_id().alias("seq"))
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("seq") - F.col("first") + F.col("offset")).alias("row_index"), "json")


def _elements(value: Column) -> Column:
    """The elements of the text of a JSON array, with their own text."""
    texts = F.from_json(value, T.ArrayType(T.StringType()))
    typed = F.from_json(value, T.ArrayType(T.VariantType()))
    # string elements lose their quotes on the way out of the array and get them back here
    return F.zip_with(texts, typed, lambda s, v: F.when(v.isNull() | s.isNull(), F.lit("null"))
                      .when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(s))


def json_document_rows(spark: SparkSession, path: str | list[str], split_over: int = SPLIT_OVER) -> DataFrame:
    """``(file, row_index, json)``: the elements of a top-level array, or the one value, with their own text.

    Arrays in files of more than ``split_over`` bytes are cut by many tasks (see ``jsonparts``). Other files are read by one
    task each; so is a large document that is not one array of JSON values, as it is one row: it must fit a Spark string (2 GiB).
    """
    docs = spark.read.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), js_trim(strip_bom(F.col("value"))).alias("value"),
        F.col("_metadata.file_size").alias("size"))
    items = F.when(F.col("value").startswith("[") & is_json(F.col("value")), _elements(F.col("value"))).otherwise(F.array("value"))

    def one_task(some: DataFrame) -> DataFrame:
        return some.select("file", F.posexplode(items).alias("row_index", "json")).withColumn(
            "row_index", F.col("row_index").cast("bigint"))

    sizes = spark.read.format("binaryFile").load(path).where(F.col("length") > split_over)
    if sizes.select("path").isEmpty():
        return one_task(docs)
    elements = array_elements(spark, path, split_over)
    empty = F.col("first") & F.col("closed") & (js_trim(F.col("text")) == "")
    judged = elements.withColumn("sound", F.col("sound") & (empty | is_json(F.col("text"))))
    # one row per file of this size; the elements themselves stay where they were cut
    path_odd = work_path(spark, "json-odd")
    judged.groupBy("file").agg(F.bool_and("sound").alias("sound"), F.sum(F.col("closed").cast("int")).alias("ends")).where(
        "NOT sound OR ends <> 1").select("file").write.parquet(path_odd)
    odd = F.broadcast(spark.read.parquet(path_odd))
    good = numbered(elements.join(odd, "file", "left_anti").where(~empty)).select(
        "file", "row_index", F.get(_elements(F.concat(F.lit("["), "text", F.lit("]"))), F.lit(0)).alias("json"))
    rows = one_task(docs.where(F.col("size") <= split_over)).unionByName(good)
    return rows if odd.isEmpty() else rows.unionByName(one_task(docs.where(F.col("size") > split_over).join(odd, "file")))


def _table(rows: DataFrame, retype: bool, columns: list[str] | None, types: dict[str, str] | None) -> DataFrame:
    """One pass finds what is not given of columns and types; the next one checks and parses each row once."""
    text = js_trim(F.col("json"))
    if columns is None or (retype and types is None):
        wrapped = F.concat(F.lit('{"value":'), text, F.lit(',"row_index":'), F.col("row_index").cast("string"), F.lit("}"))
        rows_seen = rows.select("row_index", F.when(text.startswith("{"), text).otherwise(wrapped).alias("row_json"))
        found = infer_columns(rows_seen) if retype and types is None else dict.fromkeys(ordered_columns(rows_seen))
        columns = list(found) if columns is None else columns
        types = {c: found.get(c, "string") for c in columns} if types is None and retype else types
    checked = normalize_rows(rows, "json", "row_index").withColumn("row_json", F.coalesce(
        "row_json", F.raise_error(F.concat(F.lit("JSON_INVALID: row "), F.col("row_index"))).cast("string")))
    table = rows_to_table(checked, columns)
    return retype_text(table, types) if retype else table


def read_jsonl(spark: SparkSession, path: str | list[str], retype: bool = True, columns: list[str] | None = None,
               types: dict[str, str] | None = None) -> DataFrame:
    """JSON Lines as a table: columns in first-seen order, values re-typed from their text; broken lines are an error.

    Columns and types are found in one pass over the data; known ``columns`` and ``types`` save it.
    """
    return _table(json_line_rows(spark, path), retype, columns, types)


def read_json(spark: SparkSession, path: str | list[str], retype: bool = True, columns: list[str] | None = None,
              types: dict[str, str] | None = None) -> DataFrame:
    """A JSON document as a table: one row per element of the top-level array, or one row for a single value."""
    # written in files of bounded length, so a document is parsed as a whole once, and its elements by many tasks
    cut = work_path(spark, "elements")
    json_document_rows(spark, path).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(cut)
    return _table(spark.read.schema("file string, row_index bigint, json string").parquet(cut), retype, columns, types)


def _ipc(content: bytes):
    buffer = pa.BufferReader(content)
    return pa.ipc.open_file(buffer) if content[:6] == b"ARROW1" else pa.ipc.open_stream(buffer)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC scan, one task per group of files; the schema comes from one file's own header."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_pydict({"s": [_ipc(value.as_py()).schema.serialize().to_pybytes()]})

    first = files.limit(1).mapInArrow(schema_of, "s binary").first()
    if first is None:
        raise ValueError("DATA_SOURCE_UNSUPPORTED: no Arrow file at " + path)
    arrow_schema = pa.ipc.read_schema(pa.BufferReader(first["s"]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                reader = _ipc(value.as_py())
                if hasattr(reader, "num_record_batches"):
                    yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
                else:
                    yield from reader

    return files.mapInArrow(decode, from_arrow_schema(arrow_schema))
