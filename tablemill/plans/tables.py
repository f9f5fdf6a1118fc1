"""Queries for scans, sinks, inspection, the JSON bridge and workbooks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.tables import spread
from tablemill.operators import inspect, jsonbridge, validate, workbook
from tablemill.operators.proof import compare_rows
from tablemill.plans.registry import TABLES, query
from tablemill.session import work_path
from tablemill.sinks import writers
from tablemill.sources import files as sources
from tablemill.sources import tabular
from tablemill.sources.sqlite import read_sqlite, sqlite_catalogue
from tablemill.sources.workbook import workbook_cells

# ---- scans, each over files written from a whole table ----


@query("s1_k1_csv_round_trip", "SELECT * FROM lineitem")
def csv(spark, t):
    path = work_path(spark, "csv")
    writers.write_csv(t.lineitem, path, ";")
    return tabular.read_csv(spark, path)


@query("s1_k1_csv_multiline", "SELECT doc_id, text, n_chars FROM documents")
def csv_multiline(spark, t):
    path = work_path(spark, "csv")
    writers.write_csv(t.documents.select("doc_id", "text", "n_chars"), path)
    return tabular.read_csv(spark, path, ",", schema="doc_id bigint, text string, n_chars bigint", multiline=True)


@query("s2_tsv_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def tsv(spark, t):
    path = work_path(spark, "tsv")
    writers.write_tsv(t.nation, path)
    return tabular.read_tsv(spark, path)


EVENTS_BACK = """SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def _events(t) -> DataFrame:
    return t.events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("s4_k3_jsonl_round_trip", EVENTS_BACK)
def jsonl(spark, t):
    path = work_path(spark, "jsonl")
    writers.write_jsonl(_events(t), path)
    return tabular.read_jsonl(spark, path)


@query("s3_k2_json_round_trip", EVENTS_BACK)
def json_document(spark, t):
    path = work_path(spark, "json")
    # written in files of bounded length, by many tasks even where the table is one compact file
    writers.write_json_array(spread(_events(t), 200_000), path)
    return tabular.read_json(spark, path)


@query("s3_split_document", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def split_document(spark, t):
    """One large array, cut by byte ranges; the elements are parsed under a known schema."""
    path = work_path(spark, "json")
    writers.write_json_array(t.documents, path)
    rows = tabular.json_document_rows(spark, path, split_over=64 << 10)
    fields = "doc_id string, text string, lang string, source string, n_chars string"
    cells = rows.select(F.from_json("json", fields).alias("r")).select("r.*")
    return cells.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "n_chars")})


@query("s5_k4_parquet_round_trip", "SELECT * FROM orders")
def parquet(spark, t):
    path = work_path(spark, "parquet")
    writers.write_parquet(t.orders, path)
    return tabular.read_parquet(spark, path)


@query("s6_k5_arrow_round_trip", "SELECT * FROM customer")
def arrow(spark, t):
    path = work_path(spark, "arrow")
    writers.write_arrow(t.customer, path)
    return tabular.read_arrow(spark, path)


@query("s7_k6_sqlite_round_trip", "SELECT * FROM supplier_".replace("supplier_", """(
SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal, CAST(s_acctbal > 0 AS BIGINT) AS solvent FROM supplier)"""))
def sqlite(spark, t):
    path = work_path(spark, "sqlite")
    writers.write_sqlite_shards(t.supplier.withColumn("solvent", F.col("s_acctbal") > 0), path)
    return read_sqlite(spark, path)


@query("i4_sqlite_catalogue", """
SELECT 'data' AS name, 'table' AS type, count(*)::BIGINT AS rows, 'c_custkey:INTEGER,c_name:TEXT,c_nationkey:INTEGER,c_acctbal:REAL,c_mktsegment:TEXT' AS columns FROM customer
""")
def sqlite_tables(spark, t):
    path = work_path(spark, "sqlite")
    writers.write_sqlite_shards(t.customer, path)
    listed = sqlite_catalogue(spark, path)
    columns = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"])), ",")
    return listed.groupBy("name", "type", columns.alias("columns")).agg(F.sum("rows").alias("rows"))


@query("s9_scan_files")
def file_heads(spark, t):
    """The parquet files of the given tables: size and format by content."""
    from tablemill.operators.formats import detect_formats

    found = sources.scan_files(spark, [t.path(n) for n in TABLES])
    return detect_formats(found).select("name", "size", "format_id", "confidence")


@query("k7_archive_shards", """
SELECT doc_id AS idx, 'docs/' || lang || '/doc' || CASE WHEN rn > 1 THEN ' (' || rn || ')' ELSE '' END || '.txt' AS path, text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
""")
def archives(spark, t):
    path = work_path(spark, "zip")
    bodies = t.documents.select(F.col("doc_id").alias("idx"), F.concat(F.lit("docs/"), "lang", F.lit("/doc.txt")).alias("path"),
                                F.encode(F.concat_ws("|", "doc_id", "text"), "UTF-8").alias("content"))
    writers.write_archive_shards(bodies, path, "zip", 6, shards=4)
    packed = sources.load_files(spark, path + "/*.zip").select(F.col("path").alias("archive_id"), "content").withColumn(
        "format_id", F.lit("zip"))
    text = F.decode("content", "UTF-8")
    return sources.extract_archives(packed).select(
        F.substring_index(text, "|", 1).cast("bigint").alias("idx"), "path",
        F.substring(text, F.position(F.lit("|"), text) + 1, F.length(text)).alias("text"))


@query("k7_tar_shards", "SELECT doc_id AS idx, 'doc-' || doc_id || '.txt' AS path, strlen(text) AS size FROM documents")
def tars(spark, t):
    path = work_path(spark, "tar")
    bodies = t.documents.select(F.col("doc_id").alias("idx"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("path"),
                                F.encode("text", "UTF-8").alias("content"))
    writers.write_archive_shards(bodies, path, "tar-gzip", shards=3)
    packed = sources.load_files(spark, path + "/*.tar.gz").select("path", "content", F.lit("tar-gzip").alias("format_id"))
    return sources.scan_archive_entries(packed).select(
        F.regexp_extract("path", r"doc-(\d+)", 1).cast("bigint").alias("idx"), "path", "size")


@query("k8_sheets", """
SELECT 'workbook-assets-na_tion.csv' AS file, count(*) AS rows FROM nation UNION ALL
SELECT 'workbook.csv' AS file, count(*) AS rows FROM customer
""")
def sheets(spark, t):
    folder = work_path(spark, "sheets")
    paths = writers.write_sheets({"customers": t.customer, "na/tion": t.nation}, folder, "csv")
    rows = [spark.read.option("header", True).csv(p).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(p.rsplit("/", 1)[-1]).alias("file"), "rows") for p in paths]
    return rows[0].unionByName(rows[1])


# ---- inspection ----

@query("i1_describe", """
WITH d(position, name, type) AS (VALUES (0, 'l_orderkey', 'BIGINT'), (1, 'l_partkey', 'BIGINT'), (2, 'l_suppkey', 'BIGINT'),
  (3, 'l_linenumber', 'INTEGER'), (4, 'l_quantity', 'DOUBLE'), (5, 'l_extendedprice', 'DOUBLE'), (6, 'l_discount', 'DOUBLE'),
  (7, 'l_tax', 'DOUBLE'), (8, 'l_returnflag', 'VARCHAR'), (9, 'l_linestatus', 'VARCHAR'), (10, 'l_shipdate', 'TIMESTAMP'))
SELECT position, name, type, TRUE AS nullable, (SELECT count(*) FROM lineitem) AS rows FROM d
""")
def describe(spark, t):
    counted = inspect.row_count(t.lineitem).select(F.col("row_count").alias("rows"), F.lit(1).alias("one"))
    return inspect.describe_schema(t.lineitem).withColumn("one", F.lit(1)).join(F.broadcast(counted), "one").drop("one")


@query("i2_row_count", "SELECT count(*) AS row_count FROM lineitem")
def rows(spark, t):
    return inspect.row_count(t.lineitem)


@query("i3_preview", """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('millisecond', o_orderdate)::INTEGER % 1000)::VARCHAR, 3, '0') || 'Z' AS o_orderdate,
  o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 20
""")
def preview(spark, t):
    return inspect.preview(t.orders, ["o_orderkey"])


@query("i4_database_catalogue", " UNION ALL ".join(f"""
SELECT '{n}' AS table_name, c.column_name, (SELECT count(*) FROM {n}) AS rows
FROM (SELECT column_name FROM (DESCRIBE {n})) c""" for n in sorted(TABLES)))
def database(spark, t):
    return inspect.inspect_database({n: getattr(t, n) for n in TABLES}).select("table_name", "column_name", "rows")


# ---- JSON bridge ----

def json_rows(t) -> DataFrame:
    """JSON values of many shapes, one per event."""
    k = F.col("event_id") % 5
    value = (F.when(k == 0, F.col("props")).when(k == 1, F.col("user_id").cast("string"))
             .when(k == 2, F.concat(F.lit('{"z": '), F.col("value"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "7": null}')))
             .when(k == 3, F.concat(F.lit("  ["), F.col("user_id"), F.lit(', "a"] ')))
             .otherwise(F.concat(F.lit('{"k": true, "n": {"b": [1, '), F.col("user_id"), F.lit(']}}'))))
    return t.events.select("event_id", value.alias("json"))


def normalized(t) -> DataFrame:
    return jsonbridge.normalize_rows(json_rows(t), "json", "event_id")


@query("j1_normalize_rows", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"value":' || user_id || ',"row_index":' || event_id || '}'
  WHEN 2 THEN '{"z": ' || value || ', "type": "' || event_type || '", "7": null}'
  WHEN 3 THEN '{"value":[' || user_id || ', "a"],"row_index":' || event_id || '}'
  ELSE '{"k": true, "n": {"b": [1, ' || user_id || ']}}' END AS row_json FROM events
""")
def normalize(spark, t):
    return normalized(t).select("event_id", "row_json")


@query("j2_column_union", """
WITH k(key, kind, pos) AS (VALUES ('k', 0, 0), ('value', 1, 0), ('row_index', 1, 1), ('7', 2, 0), ('z', 2, 1), ('type', 2, 2), ('n', 4, 1))
SELECT key, min(event_id) AS first_row, any_value(pos) AS first_pos FROM k JOIN events ON event_id % 5 = kind GROUP BY key
""")
def columns(spark, t):
    return jsonbridge.key_positions(normalized(t), "event_id")


@query("j2_rows_to_table", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 4 THEN 'true' END AS k,
  CASE event_id % 5 WHEN 1 THEN user_id::VARCHAR WHEN 3 THEN '[' || user_id || ',"a"]' END AS value,
  CASE WHEN event_id % 5 IN (1, 3) THEN event_id::VARCHAR END AS row_index, NULL AS "7",
  CASE event_id % 5 WHEN 2 THEN regexp_replace(value::VARCHAR, '\\.0$', '') END AS z,
  CASE event_id % 5 WHEN 2 THEN event_type END AS type,
  CASE event_id % 5 WHEN 4 THEN '{"b":[1,' || user_id || ']}' END AS n FROM events
""")
def table(spark, t):
    rows_ = normalized(t)
    return jsonbridge.rows_to_table(rows_, jsonbridge.ordered_columns(rows_, index_col="event_id"), ["event_id"])


@query("j3_csv_cells", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents
""")
def csv_cells(spark, t):
    return t.documents.select("doc_id", jsonbridge.csv_cell(F.col("text")).alias("cell"))


@query("j3_csv_lines", """
SELECT p_partkey || ',' || p_name || ',' || p_brand || ',' || p_type || ',' || p_size || ',' || regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') AS line FROM part
""")
def csv_lines(spark, t):
    return t.part.select(jsonbridge.csv_line(t.part).alias("line"))


@query("j4_export_values", """
SELECT o_orderkey::VARCHAR AS k, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') ||
  lpad((date_part('millisecond', o_orderdate)::INTEGER % 1000)::VARCHAR, 3, '0') || 'Z' AS day,
  list_aggregate(list_transform(string_split(o_orderpriority, ''), lambda c: ascii(c)::VARCHAR), 'string_agg', ',') AS bytes,
  o_custkey::VARCHAR AS inner_key FROM orders
""")
def export(spark, t):
    df = t.orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"),
        F.encode("o_orderpriority", "UTF-8").alias("bytes"), F.struct(F.array(F.struct("o_custkey")).alias("a")).alias("s"))
    return jsonbridge.json_export_values(df).select(
        "k", "price", "day", F.array_join(F.transform("bytes", lambda b: b.cast("string")), ",").alias("bytes"),
        F.col("s.a")[0]["o_custkey"].alias("inner_key"))


@query("j5_affinity", """
SELECT * FROM (VALUES ('k', 'INTEGER'), ('value', 'TEXT'), ('row_index', 'INTEGER'), ('z', 'REAL'), ('type', 'TEXT'), ('7', 'TEXT'), ('n', 'TEXT')) v(key, affinity)
WHERE EXISTS (SELECT 1 FROM events)
""")
def affinity(spark, t):
    return jsonbridge.infer_affinity(normalized(t), index_col="event_id")


@query("j6_coerce_cells", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad, '{"u":' || user_id || ',"t":"' || event_type || '"}' AS nested, NULL AS none FROM events
""")
def coerce(spark, t):
    df = t.events.select("event_id", (F.col("event_type") == "error").alias("bad"),
                         F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")).alias("nested"),
                         F.lit(None).cast("boolean").alias("none"))
    return jsonbridge.coerce_cells(df)


@query("j7_retype_text", """
SELECT event_id, ts::TIMESTAMP AS ts, value, event_type = 'error' AS bad, lpad(user_id::VARCHAR, 4, '0') AS code,
  ts::DATE AS day, NULL AS empty, nullif(event_type, 'click') AS type FROM events
""")
def retype(spark, t):
    text = t.events.select(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.col("value").cast("string").alias("value"), (F.col("event_type") == "error").cast("string").alias("bad"),
        F.lpad(F.col("user_id").cast("string"), 4, "0").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.lit("").alias("empty"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("type"))
    return jsonbridge.retype_text(text)


@query("j8_row_guard", "SELECT count(*) AS rows, TRUE AS stopped FROM orders")
def row_guard(spark, t):
    """The guard lets the whole table through and stops one row short of it."""
    n = t.orders.count()
    passed = jsonbridge.assert_max_rows(t.orders, n)
    try:
        jsonbridge.assert_max_rows(t.orders, n - 1)
        stopped = False
    except ValueError:
        stopped = True
    return passed.agg(F.count(F.lit(1)).alias("rows")).withColumn("stopped", F.lit(stopped))


# ---- workbooks ----

def sheet_cells(t) -> DataFrame:
    """Nations and customers as the cells of a two-sheet workbook per region."""
    from tablemill.functions.ordering import running_index

    def cells(df: DataFrame, names: list[str], sheet: str, idx: Column, order: str) -> DataFrame:
        ranked = running_index(df, ["file"], order, "row", start=1)
        wide = ranked.select("file", "row", F.posexplode(F.array(*[F.col(n).cast("string") for n in names])).alias("col", "value"))
        head = df.select("file").distinct().select(
            "file", F.lit(0).cast("bigint").alias("row"), F.posexplode(F.array(*map(F.lit, names))).alias("col", "value"))
        return head.unionByName(wide).select("file", F.lit(sheet).alias("sheet"), idx.alias("sheet_idx"), "row", "col", "value")

    nations = t.nation.withColumn("file", F.col("n_regionkey").cast("string"))
    customers = t.customer.withColumn("file", (F.col("c_custkey") % 7).cast("string"))
    return cells(nations, ["n_nationkey", "n_name"], "nations", F.lit(0), "n_nationkey").unionByName(
        cells(customers, ["c_custkey", "c_name", "c_mktsegment"], "customers",
        # the files without nations hold one sheet only
        F.when(F.col("file").cast("int") < 5, 1).otherwise(0), "c_custkey"))


@query("w1_choose_sheet", """
WITH s AS (SELECT DISTINCT n_regionkey::VARCHAR AS file, 'nations' AS sheet FROM nation UNION SELECT DISTINCT (c_custkey % 7)::VARCHAR, 'customers' FROM customer)
SELECT file, max(sheet) FILTER (WHERE sheet = 'nations') AS first_sheet, max(sheet) FILTER (WHERE sheet = 'nations') AS selected FROM s
GROUP BY file HAVING count(*) FILTER (WHERE sheet = 'nations') > 0
UNION ALL SELECT file, 'customers', 'customers' FROM s GROUP BY file HAVING count(*) FILTER (WHERE sheet = 'nations') = 0
""")
def choose(spark, t):
    cells = sheet_cells(t)
    first = workbook.choose_sheets(cells, "first").groupBy("file").agg(F.max("sheet").alias("first_sheet"))
    named = workbook.choose_sheets(cells, "selected", "nations").groupBy("file").agg(F.max("sheet").alias("selected"))
    return first.join(named, "file")


@query("w2_cells_to_table", "SELECT (c_custkey % 7)::VARCHAR AS file, c_custkey::VARCHAR AS c_custkey, c_mktsegment, NULL AS absent FROM customer")
def to_table(spark, t):
    cells = sheet_cells(t).where("sheet = 'customers'")
    return workbook.cells_to_table(cells, ["c_custkey", "c_mktsegment", "absent"]).select(
        "file", "c_custkey", "c_mktsegment", "absent")


@query("w2_positional_columns", """
SELECT n_regionkey::VARCHAR AS file, n_nationkey::VARCHAR AS _0, n_name AS _1 FROM nation
UNION ALL SELECT DISTINCT n_regionkey::VARCHAR, 'n_nationkey', 'n_name' FROM nation
""")
def positional(spark, t):
    cells = sheet_cells(t).where("sheet = 'nations'")
    return workbook.cells_to_table(cells, [0, 1], header=False).select("file", "_0", "_1")


@F.pandas_udf(T.BinaryType())
def xlsx_of(key: pd.Series, name: pd.Series, size: pd.Series) -> pd.Series:
    def pack(key: int, name: str, size: int) -> bytes:
        rels = '<Relationships xmlns="r">{}</Relationships>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Data" r:id="rId1"/>'
                       '<sheet name="Extra" state="hidden" r:id="rId2"/></sheets><definedNames><definedName name="n">Data!A1'
                       "</definedName></definedNames></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", rels.format(
                '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/>'))
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m"><si><t>name</t></si><si><r><t>am</t></r><r><t>ount</t></r></si>'
                       f"<si><t>{name}</t></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m" xmlns:r="r"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
                       '<c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c>'
                       f'<c r="B2"><f>1+{size}</f><v>{size}</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>k{key}</t></is></c>'
                       '<c r="B3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B5"/></mergeCells>'
                       '<hyperlinks><hyperlink ref="A2" r:id="rId9"/></hyperlinks></worksheet>')
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels.format('<Relationship Id="rId9" Target="http://x/"/>'))
            z.writestr("xl/worksheets/sheet2.xml", '<worksheet xmlns="m"><sheetData/></worksheet>')
            z.writestr("docProps/core.xml", f"<dc:title>{name}</dc:title><dc:creator>Ann</dc:creator>")
        return out.getvalue()
    return pd.Series([pack(*row) for row in zip(key, name, size)])


def workbooks(t) -> DataFrame:
    return spread(t.part.select("p_partkey", "p_name", "p_size")).select(F.col("p_partkey").alias("file"), xlsx_of("p_partkey", "p_name", "p_size").alias("content"))


@query("s8_w2_workbook_table", """
SELECT p_partkey AS file, p_name AS name, p_size::VARCHAR AS amount FROM part
UNION ALL SELECT p_partkey, 'k' || p_partkey, 'TRUE' FROM part
""")
def workbook_table(spark, t):
    cells = workbook.choose_sheets(workbook_cells(workbooks(t)), "first")
    return workbook.cells_to_table(cells, ["name", "amount"]).select("file", "name", "amount")


@query("w3_formula_mode", "SELECT p_partkey AS file, '=1+' || p_size AS formula, p_size::VARCHAR AS value, 0::BIGINT AS dropped FROM part")
def formulas(spark, t):
    # both modes read the cells of one decoding
    path, decoded = work_path(spark, "cells"), workbook_cells(workbooks(t))
    decoded.write.parquet(path)
    cells = spark.read.schema(decoded.schema).parquet(path)
    kept = workbook.formula_mode(cells, "preserve").where("formula IS NOT NULL").select("file", "formula", "value")
    gone = workbook.formula_mode(cells, "values").groupBy("file").agg(F.count("formula").alias("dropped"))
    return kept.join(gone.hint("merge"), "file")  # a row per workbook: too many to broadcast


@query("i5_sheet_summary", """
SELECT p_partkey AS file, 'Data' AS sheet, FALSE AS hidden, 'A1:B3' AS range, 3 AS rows, 2 AS columns, 6 AS cells, 1 AS formulas, 1 AS hyperlinks, 1 AS merges FROM part
UNION ALL SELECT p_partkey, 'Extra', TRUE, NULL, NULL, NULL, 0, 0, 0, 0 FROM part
""")
def sheet_summary(spark, t):
    return workbook.inspect_sheets(workbook_cells(workbooks(t))).drop("sheet_idx")


@query("i6_workbook_summary", """
SELECT p_partkey AS file, 2 AS sheets, 1 AS named_ranges, FALSE AS macros, FALSE AS date1904, 'Ann' AS author, p_name AS title, NULL AS company,
  'Formulas are kept as text; their stored results are used.' AS warnings FROM part
""")
def workbook_summary(spark, t):
    books = workbooks(t)
    members = sources.package_members(books.withColumnRenamed("file", "archive_id"), workbook.WORKBOOK_MEMBERS)
    out = workbook.inspect_workbooks(workbook_cells(books), members)
    return out.withColumn("warnings", F.array_join("warnings", " "))


@query("v1_validate_dataset", """
SELECT f AS format_id, TRUE AS valid, (SELECT count(*) FROM orders) AS rows, 6 AS columns, NULL AS error
FROM (SELECT unnest(['csv', 'jsonl', 'parquet', 'arrow', 'sqlite']) AS f)
UNION ALL SELECT 'parquet', FALSE, NULL, NULL, 'OUTPUT_INVALID'
""")
def dataset_check(spark, t):
    """The same table in five formats, each reopened and counted, and a CSV that claims to be Parquet."""
    out = []
    for fmt, write in (("csv", writers.write_csv), ("jsonl", writers.write_jsonl), ("parquet", writers.write_parquet),
                       ("arrow", writers.write_arrow), ("sqlite", writers.write_sqlite_shards)):
        path = work_path(spark, fmt)
        write(t.orders, path)
        out.append(validate.validate_dataset(spark, path, fmt))
        if fmt == "csv":
            out.append(validate.validate_dataset(spark, path, "parquet"))
    report = out[0]
    for one in out[1:]:
        report = report.unionByName(one)
    return report.select("format_id", "valid", "rows", "columns", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("v1_rows_proof", """
SELECT f AS format, true AS equal, count(*) AS source_rows, count(*) AS output_rows, '' AS different
FROM orders, (SELECT unnest(['csv', 'parquet', 'damaged']) AS f) WHERE f <> 'damaged' GROUP BY f
UNION ALL SELECT 'damaged', false, count(*), count(*), 'o_totalprice' FROM orders""")
def rows_proof(spark, t):
    """What was written holds the rows of its source; a changed cell is found."""
    csv, parquet, orders = work_path(spark, "csv"), work_path(spark, "parquet"), t.orders
    writers.write_csv(orders, csv)
    writers.write_parquet(orders, parquet)
    back = {"csv": tabular.read_csv(spark, csv, ",", schema=orders.schema), "parquet": tabular.read_parquet(spark, parquet)}
    first = orders.agg(F.min("o_orderkey").alias("least"))
    back["damaged"] = orders.join(F.broadcast(first)).withColumn("o_totalprice", F.when(
        F.col("o_orderkey") == F.col("least"), F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))).drop("least")
    out = None
    for name, df in back.items():
        row = compare_rows(orders, df).select(F.lit(name).alias("format"), "equal", "source_rows", "output_rows",
                                              F.array_join("different", ",").alias("different"))
        out = row if out is None else out.unionByName(row)
    return out
