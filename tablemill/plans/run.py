"""Rewriting of a whole corpus: detect, route, write per kind of file, check, report. A bad file fails alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.ordering import running_index
from tablemill.functions.text import plain_path
from tablemill.operators import formats, jsonbridge, mesh, naming, routes, science, subtitles, workbook
from tablemill.operators.query import restricted_sql, validate_query
from tablemill.session import work_path
from tablemill.sinks import writers
from tablemill.sinks.paths import filesystem
from tablemill.sources import files as sources
from tablemill.sources import tabular
from tablemill.sources.sqlite import read_sqlite
from tablemill.sources.workbook import workbook_cells

NO_ROUTE = "No local conversion route is available."
UNKNOWN = "FORMAT_UNKNOWN: File format could not be identified."
TABLES = ["csv", "tsv", "json-data", "jsonl", "parquet", "arrow", "sqlite"]
FLAT = ["csv", "tsv", "json-data", "jsonl", "parquet"]
BOOKS = ["xlsx", "xlsm", "ods", "fods"]


def plan_corpus(spark: SparkSession, inbox: str | list[str], target: str, options: dict) -> DataFrame:
    """One task row per input file: position, format, route warnings, output name, state; kept as a table."""
    heads = sources.scan_files(spark, inbox)
    found = formats.compound_suffix(formats.detect_formats(heads)).drop("content", "mime")
    seen = work_path(spark, "detected")
    found.write.parquet(seen)
    detected = spark.read.parquet(seen)

    zips = detected.where(F.col("format_id") == "zip").select("path", "name")
    if not zips.isEmpty():
        # only files that are ZIPs by content are opened again, for their member names
        bodies = sources.load_files(spark, inbox).join(zips.select("path"), "path", "left_semi").withColumnRenamed(
            "path", "archive_id")
        members = sources.package_members(bodies, ["mimetype"], 1024)
        kinds = formats.sniff_packages(members).withColumnRenamed("archive_id", "path")
        detected = formats.apply_packages(detected, kinds, "path")

    ordered = work_path(spark, "ordered")
    detected.orderBy("path").withColumn("seq", F.monotonically_increasing_id()).write.parquet(ordered)
    tasks = running_index(spark.read.parquet(ordered), [], "seq", "idx").drop("seq")

    registry = formats.format_registry(spark)
    plan = routes.plan_routes(routes.conversion_edges(spark), preference=options.get("route_preference")).where(
        F.col("target") == target)
    plan = routes.analyze_loss(plan, registry).select(
        F.col("source").alias("format_id"), F.transform("losses", lambda x: x["message"]).alias("route_warnings"),
        F.lit(True).alias("routed"))
    tasks = tasks.join(F.broadcast(plan), "format_id", "left")

    extension = next((row[4][0] for row in formats._registry_rows() if row[1] == target), target)
    total = tasks.agg(F.count(F.lit(1)).alias("total")).withColumn("__one", F.lit(1))
    tasks = tasks.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")
    named = naming.render_names(tasks, options.get("template", ""), extension, target, options.get("date", "1970-01-01"),
                                source="name")
    error = F.when(F.col("format_id").isNull(), UNKNOWN).when(F.col("routed").isNull(), NO_ROUTE)
    planned = named.withColumn("error", error)
    good = naming.unique_names(planned.where("error IS NULL"), "output_name", "idx", "unique").withColumn(
        "output_name", F.col("unique")).drop("unique")
    bad = planned.where("error IS NOT NULL").withColumn("output_name", F.lit(None).cast("string"))
    table = work_path(spark, "tasks")
    good.unionByName(bad).select(
        "idx", "path", F.col("name").alias("source_name"), "format_id", "size", "output_name", "error",
        F.coalesce("route_warnings", F.array().cast("array<string>")).alias("warnings")).write.parquet(table)
    return spark.read.parquet(table)


# ---- tables: files of one layout go through one job ----

def _footers(paths: DataFrame) -> DataFrame:
    """``(path, layout, error)`` of Parquet files from their footers, read where the tasks run."""
    import pyarrow.parquet as pq

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    system, inner = filesystem(path)
                    out.append((path, pq.read_schema(inner, filesystem=system).remove_metadata().to_string(), None))
                except Exception as error:  # a damaged file fails alone
                    out.append((path, None, f"SOURCE_INVALID: {error}"[:500]))
            yield pd.DataFrame(out, columns=["path", "layout", "error"])

    return paths.mapInPandas(read, "path string, layout string, error string")


def _layouts(spark: SparkSession, fmt: str, tasks: DataFrame) -> DataFrame:
    """``(path, layout, error)``: files with equal layouts can be read as one table."""
    paths = tasks.select("path")
    if fmt == "parquet":
        return _footers(paths.repartition("path"))
    listed = [r["path"] for r in paths.toLocalIterator()]
    if fmt in ("csv", "tsv"):
        # the header line, which also tells the delimiter
        head = sources.scan_files(spark, listed, 65_536).select("path", formats.utf8(F.col("content")).alias("t"))
        return head.select("path", F.regexp_extract("t", r"^\ufeff?([^\r\n]*)", 1).alias("layout"), F.lit(None).cast("string").alias("error"))
    if fmt in ("json-data", "jsonl"):
        rows = tabular.json_line_rows(spark, listed) if fmt == "jsonl" else tabular.json_document_rows(spark, listed)
        checked = jsonbridge.normalize_rows(rows, "json", "row_index")
        bad = checked.groupBy("file").agg(F.min(F.when(F.col("row_json").isNull(), F.col("row_index"))).alias("bad"))
        keys = checked.where("row_json IS NOT NULL").select(
            "file", F.explode(F.json_object_keys("row_json")).alias("key")).distinct().groupBy("file").agg(
            F.md5(F.array_join(F.array_sort(F.collect_set("key")), "\n")).alias("layout"))
        return bad.join(keys, "file", "left").select(
            F.col("file").alias("path"), F.coalesce("layout", F.lit("")).alias("layout"),
            F.when(F.col("bad").isNotNull(), F.concat(F.lit("JSON_INVALID: row "), F.col("bad").cast("string"))).alias("error"))
    # Arrow and SQLite files are read one by one
    return paths.select("path", F.col("path").alias("layout"), F.lit(None).cast("string").alias("error"))


def _read_tables(spark: SparkSession, fmt: str, paths: list[str], options: dict) -> DataFrame:
    """The files as one table, with the file (``__path``) and place (``__block, __row``) of every row."""
    delimiter, header = options.get("delimiter", "auto"), options.get("header", True)
    place = F.monotonically_increasing_id().alias("__row")
    if fmt in ("csv", "tsv"):
        return tabular.read_csv(spark, paths, "\t" if fmt == "tsv" else delimiter, header, multiline=options.get("multiline", True), place=True)
    if fmt == "parquet":
        return tabular.read_parquet(spark, paths).select(
            "*", plain_path(F.col("_metadata.file_path")).alias("__path"), F.lit(0).alias("__block"), F.col("_metadata.row_index").alias("__row"))
    if fmt in ("json-data", "jsonl"):
        rows = tabular.json_line_rows(spark, paths) if fmt == "jsonl" else tabular.json_document_rows(spark, paths)
        checked = jsonbridge.normalize_rows(rows, "json", "row_index").withColumn("__path", F.col("file")).withColumn(
            "__block", F.lit(0)).withColumn("__row", F.col("row_index"))
        found = jsonbridge.infer_columns(checked)
        return jsonbridge.retype_text(jsonbridge.rows_to_table(checked, list(found), ["__path", "__block", "__row"]), found)
    # one file at a time
    df = tabular.read_arrow(spark, paths[0]) if fmt == "arrow" else read_sqlite(spark, paths[0], options.get("table"))
    return df.select("*", F.lit(paths[0]).alias("__path"), F.lit(0).alias("__block"), place)


PLACE = ["__block", "__row"]


def _write_group(df: DataFrame, tasks: DataFrame, target: str, out: str, options: dict) -> DataFrame:
    """Write the rows below ``out/output_name=…``; returns ``(output_name, rows)`` as counted after reading back.

    Ranges of (output, place) are the tasks: a large file is spread over many, and its part files keep its order.
    """
    spark = df.sparkSession
    names = tasks.select(F.col("path").alias("__path"), "output_name")
    rows = df.join(names, "__path").drop("__path").repartitionByRange("output_name", *PLACE).sortWithinPartitions(
        "output_name", *PLACE)
    cells = {"header": options.get("header", True), "quote": '"', "escape": '"', "emptyValue": '""',
             "sep": "\t" if target == "tsv" else ","}
    if target in ("csv", "tsv"):
        writers.flat(rows.drop(*PLACE)).write.options(**cells).partitionBy("output_name").csv(out)
        back = spark.read.options(**cells, multiLine=True).csv(out)
    elif target == "parquet":
        rows.drop(*PLACE).write.option("compression", "zstd").partitionBy("output_name").parquet(out)
        back = spark.read.option("mergeSchema", "true").parquet(out)
    else:
        data = [c for c in rows.columns if c not in ("output_name", *PLACE)]
        export = jsonbridge.json_export_values(rows.select(*[f"`{c}`" for c in data], "output_name"))
        lines = export.select("output_name", F.to_json(
            F.struct(*[F.col(f"`{c}`") for c in data]), {"ignoreNullFields": "false"}).alias("value"))
        if target == "json-data":
            lines = lines.mapInPandas(_frame_arrays, "output_name string, value string")
        lines.write.partitionBy("output_name").text(out)
        back = spark.read.text(out).where(~F.col("value").isin("[", "]", "[]"))
    return back.groupBy("output_name").agg(F.count(F.lit(1)).alias("rows"))


def _frame_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A JSON array per output and part file: rows arrive sorted by output, so each is opened and closed once."""
    name, last = None, None
    for batch in batches:
        names, values = [], []
        for output, value in zip(batch["output_name"], batch["value"]):
            if output != name:
                if name is not None:
                    names += [name, name]
                    values += [last, "]"]
                names.append(output)
                values.append("[")
                name, last = output, value
            else:
                names.append(name)
                values.append(last + ",")
                last = value
        if names:
            yield pd.DataFrame({"output_name": names, "value": values})
    if name is not None:
        yield pd.DataFrame({"output_name": [name, name], "value": [last, "]"]})


def _run_tables(spark: SparkSession, fmt: str, tasks: DataFrame, target: str, out: str, options: dict) -> DataFrame:
    """Results ``(path, rows, error)`` of the tables of one source format."""
    layouts = work_path(spark, "layouts")
    _layouts(spark, fmt, tasks).write.parquet(layouts)
    found = spark.read.parquet(layouts)
    results = [found.where("error IS NOT NULL").select("path", F.lit(None).cast("bigint").alias("rows"), "error")]
    good = found.where("error IS NULL")
    query = validate_query(options.get("query", ""))
    # a query speaks about one file, so with a query each file is a job of its own
    group = F.col("path") if query or fmt in ("arrow", "sqlite") else F.col("layout")
    for row in good.select(group.alias("g")).distinct().toLocalIterator():
        members = good.where(group == row["g"]).select("path")
        results.append(_run_group(spark, fmt, tasks.join(members, "path", "left_semi"), target, out, options, query))
    return reduce(DataFrame.unionByName, results)


def _run_group(spark, fmt, tasks: DataFrame, target: str, out: str, options: dict, query: str) -> DataFrame:
    paths = [r["path"] for r in tasks.select("path").toLocalIterator()]
    try:
        df = _read_tables(spark, fmt, paths, options)
        if query:
            df = restricted_sql({"data": df.drop("__path", *PLACE)}, query).select(
                "*", F.lit(paths[0]).alias("__path"), F.lit(0).alias("__block"), F.monotonically_increasing_id().alias("__row"))
        folder = work_path(spark, "group")
        counted = _write_group(df, tasks, target, folder, options)
        kept = work_path(spark, "counts")
        counted.write.parquet(kept)
        _publish(spark, folder, out)
        done = tasks.join(spark.read.parquet(kept), "output_name", "left")
        return done.select("path", "rows", F.when(
            F.col("rows").isNull(), "OUTPUT_INVALID: Output is empty.").alias("error"))
    except Exception as error:
        if len(paths) > 1:
            # find out which file it was: each one again by itself
            return reduce(DataFrame.unionByName, [
                _run_group(spark, fmt, tasks.where(F.col("path") == p), target, out, options, query) for p in paths])
        text = f"CONVERSION_FAILED: {str(error).strip().splitlines()[0]}"[:500]
        return spark.createDataFrame([(paths[0], None, text)], "path string, rows bigint, error string")


def _publish(spark: SparkSession, folder: str, out: str) -> None:
    """Move the finished output folders of a group into place."""
    from pyarrow import fs

    system, inner = filesystem(folder)
    _, home = filesystem(out)
    system.create_dir(home, recursive=True)
    for item in system.get_file_info(fs.FileSelector(inner)):
        if item.base_name.startswith("output_name="):
            system.move(item.path, f"{home}/{item.base_name}")


# ---- texts: every file is a row, all files of a format go through one job ----

def _texts(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    listed = [r["path"] for r in tasks.select("path").toLocalIterator()]
    return sources.load_files(spark, listed).select("path", "content", formats.utf8(F.col("content")).alias("text"))


def _write_texts(parts: DataFrame, tasks: DataFrame, order: list[str], out: str) -> DataFrame:
    """Parts of each file, in order, as one text file below ``output_name=…``; returns ``(path, rows, error)``."""
    named = parts.where("text IS NOT NULL").join(tasks.select("path", "output_name"), "path")
    body = named.select("output_name", *order, F.regexp_replace("text", r"\n$", "").alias("value"))
    body.repartition("output_name").sortWithinPartitions("output_name", *order).select("output_name", "value").write.mode(
        "append").partitionBy("output_name").text(out)
    return parts.groupBy("path").agg(F.count("text").alias("rows"))


def _run_texts(spark: SparkSession, fmt: str, tasks: DataFrame, target: str, out: str, options: dict) -> DataFrame:
    docs = _texts(spark, tasks)
    nothing = F.lit(None).cast("string")
    if fmt in subtitles.FORMATS:
        parts = subtitles.translate_subtitles(docs, fmt, target, "path")
        written = _write_texts(parts, tasks, ["part"], out)
        return parts.groupBy("path").agg(F.max("error").alias("error")).join(written, "path").select("path", "rows", "error")
    if fmt in ("obj", "stl", "ply"):
        named = docs.withColumnRenamed("path", "mesh_id")
        vertices, triangles = (mesh.parse_stl(named) if fmt == "stl" else
                               {"obj": mesh.parse_obj, "ply": mesh.parse_ply}[fmt](named))
        report = mesh.mesh_guard(vertices, triangles)
        fine = report.where("error IS NULL").select("mesh_id")
        parts = mesh.serialize_mesh(vertices.join(fine, "mesh_id", "left_semi"), triangles.join(fine, "mesh_id", "left_semi"),
                                    target).withColumnRenamed("mesh_id", "path")
        _write_texts(parts, tasks, ["section", "part"], out)
        return tasks.select("path").join(report.withColumnRenamed("mesh_id", "path"), "path", "left").select(
            "path", F.col("triangles").alias("rows"), F.when(
                F.col("vertices").isNull(), "MESH_PARSE_FAILED: No triangle geometry.").otherwise(F.col("error")).alias("error"))
    if fmt == "fits":
        cards = science.fits_cards(docs)
        lines = cards.select("path", "idx", F.to_json(F.struct("keyword", "value", "comment"), {"ignoreNullFields": "false"})
                             .alias("value")).join(tasks.select("path", "output_name"), "path")
        lines.repartition("output_name").sortWithinPartitions("output_name", "idx").select("output_name", "value").mapInPandas(
            _frame_arrays, "output_name string, value string").write.mode("append").partitionBy("output_name").text(out)
        counts = cards.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
        return science.fits_headers(docs).select("path", "error").join(counts, "path", "left").select("path", "rows", "error")
    if fmt == "fb2":
        blocks = science.fb2_blocks(docs)
        parts = science.fb2_html(blocks)
        _write_texts(parts, tasks, ["section", "part"], out)
        return blocks.groupBy("path").agg(F.count("kind").alias("rows"), F.max("error").alias("error"))
    # workbooks: the lines of the chosen sheet, blank rows and cells kept
    cells = workbook_cells(docs.withColumnRenamed("path", "file"))
    policy = options.get("sheet_policy", "first")
    workbook.check_sheet_policy(policy, target)
    chosen = workbook.choose_sheets(cells.where("error IS NULL"), "first" if policy == "all" else policy, options.get("sheet"))
    sep = "\t" if target == "tsv" else ","
    body = chosen.where("kind = 'cell'")
    width = body.groupBy("file").agg(F.max("col").alias("last"), F.min("row").alias("r0"), F.min("col").alias("c0"))
    filled = body.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct(
        "col", jsonbridge.csv_cell(F.col("text"), delimiter=sep).alias("t")))).alias("m")).join(width, "file")
    line = F.array_join(F.transform(F.sequence("c0", "last"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), sep)
    parts = filled.select(F.col("file").alias("path"), (F.col("row") - F.col("r0")).cast("bigint").alias("part"), line.alias("text"))
    written = _write_texts(parts, tasks, ["part"], out)
    broken = cells.where("error IS NOT NULL").select(F.col("file").alias("path"), "error")
    return tasks.select("path").join(written, "path", "left").join(broken, "path", "left").select(
        "path", "rows", F.coalesce("error", F.when(F.col("rows").isNull(), "SPREADSHEET_EMPTY: Workbook contains no cells.")
                                   , nothing).alias("error"))


def _handler(fmt: str, target: str):
    if fmt in TABLES and target in FLAT:
        return _run_tables
    if fmt in subtitles.FORMATS and target in subtitles.FORMATS:
        return _run_texts
    if fmt in ("obj", "stl", "ply") and target in ("obj", "ply"):
        return _run_texts
    if (fmt, target) in (("fits", "json-data"), ("fb2", "html-doc")) or (fmt in BOOKS and target in ("csv", "tsv")):
        return _run_texts
    return None


def run_corpus(spark: SparkSession, inbox: str | list[str], target: str, out: str, options: dict | None = None) -> DataFrame:
    """Rewrite all files below ``inbox`` as ``target``; the outputs lie at ``out/output_name=<name>/``.

    Returns the task table ``(idx, source_name, format_id, state, stage, progress, output_name, rows, error, warnings)``.
    Options: ``query, delimiter, header, multiline, table, sheet_policy, sheet, template, date, route_preference``.
    """
    options = options or {}
    validate_query(options.get("query", ""))
    tasks = plan_corpus(spark, inbox, target, options)
    # at most one row per registered format
    present = [r["format_id"] for r in tasks.where("error IS NULL").select("format_id").distinct().collect()]
    results = []
    for fmt in sorted(present):
        mine = tasks.where((F.col("format_id") == fmt) & F.col("error").isNull())
        handler = _handler(fmt, target)
        if handler is None:
            results.append(mine.select("path", F.lit(None).cast("bigint").alias("rows"), F.lit(
                f"ENGINE_UNAVAILABLE: {fmt} to {target} needs an external codec.").alias("error")))
            continue
        done = work_path(spark, "results")
        handler(spark, fmt, mine, target, out, options).select("path", "rows", "error").write.parquet(done)
        results.append(spark.read.parquet(done))
    planned_bad = tasks.where("error IS NOT NULL").select(
        "path", F.lit(None).cast("bigint").alias("rows"), F.col("error").alias("e"), F.lit("Cannot plan").alias("stage"))
    merged = planned_bad
    for result in results:
        merged = merged.unionByName(result.select("path", "rows", F.col("error").alias("e"), F.when(
            F.col("error").isNull(), "Complete").otherwise("Failed").alias("stage")))
    return tasks.drop("error").join(merged, "path").select(
        "idx", "source_name", "format_id", F.when(F.col("e").isNull(), "completed").otherwise("failed").alias("state"),
        "stage", F.lit(1.0).alias("progress"), F.when(F.col("e").isNull(), F.col("output_name")).alias("output_name"),
        F.when(F.col("e").isNull(), F.col("rows")).alias("rows"), F.col("e").alias("error"), "warnings")
