"""Checks of written or claimed outputs: reopened datasets, re-parsed texts, corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import js_trim, strip_bom
from tablemill.operators import mesh, subtitles
from tablemill.operators.formats import PROBE, category_of, match_content
from tablemill.operators.jsonbridge import MAX_COLUMNS, is_json


def validate_dataset(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """One row ``(format_id, valid, rows, columns, size, files, error)`` for a dataset on disk, read back in full.

    ``options`` go to the reader (delimiter, header, multiline ...).
    """
    from tablemill.sources import tabular
    from tablemill.sources.sqlite import read_sqlite

    readers = {
        "csv": tabular.read_csv, "tsv": tabular.read_tsv, "json-data": tabular.read_json, "jsonl": tabular.read_jsonl,
        "parquet": tabular.read_parquet, "arrow": tabular.read_arrow, "sqlite": read_sqlite,
    }
    schema = "format_id string, valid boolean, rows bigint, columns int, size bigint, files bigint, error string"
    # _SUCCESS and other marker files are no data
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn(
        "n", F.regexp_extract("path", r"([^/]+)$", 1)).where("n NOT LIKE '\\_%' AND n NOT LIKE '.%'")
    bodies = files.select("length")
    try:
        found = bodies.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("files")).first()
        if not found["size"]:
            raise ValueError("Output is empty.")
        heads = files.select(F.substring("content", 1, PROBE).alias("content"))
        same = ["json-data", "jsonl"] if fmt in ("json-data", "jsonl") else [fmt]
        other = match_content(heads).where(F.col("content_id").isNotNull() & ~F.col("content_id").isin(same)).first()
        if other is not None:
            raise ValueError(f"Content is {other['content_id']}, not {fmt}.")
        df = readers[fmt](spark, path, **options)
        row = (fmt, True, df.count(), len(df.columns), found["size"], found["files"], None)
    except Exception as error:
        row = (fmt, False, None, None, None, None, f"OUTPUT_INVALID: Output could not be reopened: {str(error)[:500]}")
    return spark.createDataFrame([row], schema)


def validate_json(docs: DataFrame, lines: bool, doc: str = "doc_id", text: str = "text",
                  max_columns: int = MAX_COLUMNS) -> DataFrame:
    """``(doc, valid, rows, columns, error)``: re-parse of every JSON document or JSON Lines file in the table."""
    body = strip_bom(F.col(text))
    if lines:
        items = F.filter(F.transform(F.split(body, r"\r?\n"), js_trim), lambda v: v != "")
        rows = docs.select(doc, F.posexplode_outer(items).alias("i", "item"), F.lit(True).alias("whole_ok"))
    else:
        value = js_trim(body)
        staged = docs.select(doc, value.alias("v"), is_json(value).alias("whole_ok"))
        typed = F.from_json("v", "array<variant>")
        elements = F.transform(typed, lambda e: F.coalesce(F.to_json(e), F.lit("null")))
        items = F.when(F.col("whole_ok"), F.when(F.col("v").startswith("["), elements).otherwise(F.array("v")))
        rows = staged.select(doc, F.posexplode_outer(items).alias("i", "item"), "whole_ok")
    keys = F.when(F.col("item").startswith("{"), F.json_object_keys("item")).otherwise(
        F.array(F.lit("value"), F.lit("row_index")))
    checked = rows.select(
        doc, "i", "whole_ok", F.when(F.col("item").isNotNull(), is_json(F.col("item"))).alias("ok"), keys.alias("keys"))
    facts = checked.groupBy(doc).agg(
        F.bool_and("whole_ok").alias("whole_ok"), F.bool_and(F.coalesce("ok", F.lit(True))).alias("ok"),
        F.count("i").alias("rows"), F.min(F.when(~F.col("ok"), F.col("i"))).alias("bad"))
    # distinct keys are counted by their own grouping, so that no key set is gathered per file
    names = checked.where("i IS NOT NULL").select(doc, F.explode("keys").alias("key")).distinct().groupBy(doc).agg(
        F.count(F.lit(1)).alias("columns"))
    joined = facts.join(names, doc, "left").withColumn("columns", F.greatest(F.coalesce("columns", F.lit(0)), F.lit(1)))
    error = (
        F.when(~F.col("whole_ok"), "Output JSON could not be reparsed: not one JSON value.")
        .when(~F.col("ok"), F.concat(F.lit("Output JSON could not be reparsed: row "), F.col("bad").cast("string")))
        .when(F.col("columns") > max_columns,
              "Output JSON could not be reparsed: DATA_COLUMN_LIMIT: JSON input contains too many distinct columns."))
    valid = error.isNull()
    return joined.select(doc, valid.alias("valid"), F.when(valid, F.col("rows")).alias("rows"),
                         F.when(valid, F.col("columns")).alias("columns"), error.alias("error"))


def validate_text(docs: DataFrame, fmt: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, valid, error)`` for subtitle (srt, vtt, ass) and mesh (obj, ply) files."""
    if fmt in subtitles.FORMATS:
        checked = subtitles.parse_documents(docs, fmt, text).select(doc, "error")
    else:
        checked = mesh.mesh_report(docs, fmt, doc, text).select(doc, "error")
    return checked.select(doc, F.col("error").isNull().alias("valid"), "error")


def validation_report(audited: DataFrame, declared: str = "declared") -> DataFrame:
    """Files per category of the declared format and outcome, for an audited table with ``valid``."""
    return audited.groupBy(category_of(F.col(declared)).alias("category"), "valid").agg(F.count(F.lit(1)).alias("files"))
