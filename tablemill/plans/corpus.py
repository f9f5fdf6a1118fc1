"""Queries over file catalogues, archive entries and batch tasks that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators import archive, batch, formats, naming, routes
from tablemill.plans.registry import TABLES, query
from tablemill.session import work_path
from tablemill.streaming import by_content
from tablemill.streaming.by_content import intake_by_content
from tablemill.streaming.ingest import ingest_available

# One kind of content per page: (hex or text, the format it must be taken for).
CONTENTS = [
    (None, "html-doc"),
    ('{"u": 1}', "json-data"),
    ('{"a": 1}\n{"a": 2}\n', "jsonl"),
    ("1\n00:00:01,000 --> 00:00:02,000\nhi\n", "srt"),
    ("WEBVTT\n\n00:01.000 --> 00:02.000\nhi", "vtt"),
    ("hex:89504E470D0A1A0A0000000D", "png"),
    ("hex:504B030414000000", "zip"),
    ("hex:1F8B0800", "gzip"),
    ("hex:524946460000000057415645", "wav"),
    ("hex:FFFB9000", "mp3"),
    ("hex:FFF15080", "aac"),
    ("{\\rtf1 hello", "rtf"),
    ("plain words", None),
    ("Go on", "mpegts"),
    ("\\documentclass{article}", "latex"),
    ("hex:49492A0008000000", "tiff"),
]
EXTENSIONS = [("html", "html-doc"), ("jsonl", "jsonl"), ("txt", "txt"), ("nef", "camera-raw"), ("tar.gz", "gzip"),
              ("PNG", "png"), ("bin", None)]
MIMES = [("", None), ("text/html", "html-doc"), ("application/octet-stream", "parquet"), ("text/plain", "txt"),
         ("image/png", "png")]


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def catalogue(t) -> DataFrame:
    """A catalogue of files: one row per page with name, media type and bytes."""
    content = F.encode(F.col("html"), "UTF-8")
    for i, (body, _) in enumerate(CONTENTS):
        if body is not None:
            data = F.unhex(F.lit(body[4:])) if body.startswith("hex:") else F.encode(F.lit(body), "UTF-8")
            content = F.when(F.col("page_id") % len(CONTENTS) == i, data).otherwise(content)
    return t.pages.select(
        "page_id", (F.col("page_id") % 11).alias("batch"),
        F.concat(F.lit("p"), F.col("page_id"), F.lit("."), _pick([e for e, _ in EXTENSIONS], F.col("page_id") % 7))
        .alias("name"),
        _pick([m for m, _ in MIMES], F.col("page_id") % 5).alias("mime"), content.alias("content"))


def _sql_pick(values: list, key: str) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}][({key})::BIGINT + 1]"


CATALOGUE_SQL = f"""
c0 AS (SELECT page_id, page_id % 11 AS batch, 'p' || page_id || '.' || {_sql_pick([e for e, _ in EXTENSIONS], 'page_id % 7')} AS name,
  {_sql_pick([f for _, f in CONTENTS], f'page_id % {len(CONTENTS)}')} AS body,
  {_sql_pick([f for _, f in EXTENSIONS], 'page_id % 7')} AS ext, {_sql_pick([f for _, f in MIMES], 'page_id % 5')} AS mim,
  page_id % 5 IN (2, 3) AS generic FROM pages),
c1 AS (SELECT *, CASE WHEN ext IS NOT NULL AND generic THEN ext ELSE coalesce(mim, ext) END AS hint,
  coalesce((ext = 'jsonl' AND body = 'json-data') OR (ext = 'camera-raw' AND body = 'tiff'), FALSE) AS ov FROM c0),
c2 AS (SELECT *, CASE WHEN ov THEN ext ELSE coalesce(body, hint) END AS fid,
  CASE WHEN ov THEN 0.92 WHEN body IS NOT NULL THEN 0.99 WHEN hint IS NOT DISTINCT FROM mim THEN 0.75
       WHEN ext IS NOT NULL THEN 0.62 ELSE 0.0 END AS conf,
  concat_ws('; ', CASE WHEN body IS NOT NULL THEN 'Matched file content' END,
    CASE WHEN mim IS NOT NULL THEN 'Matched MIME hint' END,
    CASE WHEN ext IS NOT NULL THEN 'Matched filename extension' END) AS why,
  concat_ws('; ', CASE WHEN body <> ext AND NOT ov THEN 'Filename extension does not match the file contents.' END,
    CASE WHEN body <> mim THEN 'Reported MIME type does not match the file contents.' END) AS warn FROM c1),
detected AS (SELECT page_id, batch, name, body, CASE WHEN name LIKE '%.tar.gz' THEN 'tar-gzip' ELSE fid END AS format_id,
  CAST(CASE WHEN name LIKE '%.tar.gz' THEN greatest(0.92, conf) ELSE conf END AS DOUBLE) AS confidence,
  CASE WHEN name LIKE '%.tar.gz' THEN concat_ws('; ', 'Matched compound archive suffix', nullif(why, '')) ELSE why END AS reasons,
  warn AS warnings FROM c2)
"""


def detected(t) -> DataFrame:
    return formats.compound_suffix(formats.detect_formats(catalogue(t)))


@query("f2_signatures", f"""
SELECT page_id, CASE WHEN f IN ('png', 'zip', 'gzip', 'tiff') THEN f END AS signature_id
FROM (SELECT page_id, {_sql_pick([f for _, f in CONTENTS], f'page_id % {len(CONTENTS)}')} AS f FROM pages)
""")
def signatures(spark, t):
    return formats.match_signatures(catalogue(t)).select("page_id", "signature_id")


@query("f3_content_tests", f"""
SELECT page_id, {_sql_pick([f for _, f in CONTENTS], f'page_id % {len(CONTENTS)}')} AS content_id FROM pages
""")
def content(spark, t):
    return formats.match_content(catalogue(t)).select("page_id", "content_id")


@query("f3_plain_documents", """
SELECT doc_id, CASE WHEN regexp_matches(text[:8192], '\\\\(?:documentclass|begin\\s*\\{document\\})') THEN 'latex'
  WHEN regexp_matches(text[:8192], '(?i)^\\s*(?:<!doctype\\s+html|<html(?:\\s|>))') THEN 'html-doc'
  WHEN text[:1] IN ('{', '[') THEN 'json-data'
  WHEN text[:1] = 'G' AND (octet_length(encode(text)) < 376 OR ascii(decode(encode(text)[189:189])) = 71) THEN 'mpegts'
  END AS content_id
FROM documents
""")
def documents_as_files(spark, t):
    """Every document as a file."""
    found = formats.match_content(t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content")))
    return found.select("doc_id", "content_id")


@query("f4_hints", f"""
SELECT page_id, {_sql_pick([f for _, f in EXTENSIONS], 'page_id % 7')} AS extension_id,
       {_sql_pick([f for _, f in MIMES], 'page_id % 5')} AS mime_id FROM pages
""")
def hints(spark, t):
    return formats.match_hints(catalogue(t)).select("page_id", "extension_id", "mime_id")


@query("f5_f6_detect", f"""
WITH {CATALOGUE_SQL} SELECT page_id, format_id, confidence, reasons, warnings FROM detected
""")
def detect(spark, t):
    return detected(t).select("page_id", "format_id", "confidence", F.array_join("reasons", "; ").alias("reasons"),
                              F.array_join("warnings", "; ").alias("warnings"))


# Members of packages built from documents: one package per document.
PACKAGES = [
    (["word/document.xml"], "docx"), (["word/document.xml", "word/vbaProject.bin"], "docm"),
    (["ppt/presentation.xml"], "pptx"), (["xl/workbook.bin", "xl/workbook.xml"], "xlsb"), (["xl/workbook.xml"], "xlsx"),
    (["xl/workbook.xml", "xl/vbaProject.bin"], "xlsm"), (["META-INF/container.xml", "OEBPS/a.opf"], "epub"),
    (["mimetype", "content.xml"], "odt"), (["readme.txt"], None),
]


@query("f7_packages", f"""
SELECT doc_id AS archive_id, {_sql_pick([k for _, k in PACKAGES], f'doc_id % {len(PACKAGES)}')} AS package_id FROM documents
""")
def packages(spark, t):
    names = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m, _ in PACKAGES]),
                         (F.col("doc_id") % len(PACKAGES) + 1).cast("int"))
    members = t.documents.select(F.col("doc_id").alias("archive_id"), F.explode(names).alias("path")).withColumn(
        "content", F.when(F.col("path") == "mimetype", F.encode(F.lit("application/vnd.oasis.opendocument.text\n"), "UTF-8")))
    return formats.sniff_packages(members)


LABELS = ["png", "wav", "mp3", "flac", "zip", "html-doc"]


@query("f8_label_audit", f"""
WITH x AS (SELECT page_id, {_sql_pick([f for _, f in CONTENTS], f'page_id % {len(CONTENTS)}')} AS body,
  {_sql_pick(LABELS, 'page_id % 6')} AS declared FROM pages)
SELECT page_id, declared, concat_ws('; ',
  CASE WHEN coalesce(body, declared) <> declared THEN 'Output signature does not match requested format.' END,
  CASE WHEN (declared = 'flac') OR (declared = 'wav' AND body IS DISTINCT FROM 'wav')
         OR (declared = 'mp3' AND (body IS NULL OR body NOT IN ('mp3', 'aac')))
       THEN 'Output magic bytes do not match the requested audio format.' END) AS errors,
  errors = '' AS valid
FROM x
""")
def labels(spark, t):
    claimed = catalogue(t).withColumn("declared", _pick(LABELS, F.col("page_id") % 6))
    return formats.audit_labels(claimed).select(
        "page_id", "declared", F.array_join("errors", "; ").alias("errors"), "valid")


KIND_SQL = """CASE WHEN format_id IS NULL THEN NULL WHEN format_id IN ('png', 'tiff') THEN 'image'
  WHEN format_id IN ('html-doc', 'rtf', 'txt', 'latex') THEN 'document' WHEN format_id IN ('json-data', 'jsonl', 'parquet') THEN 'data'
  WHEN format_id IN ('srt', 'vtt', 'camera-raw') THEN 'specialist' WHEN format_id IN ('zip', 'gzip', 'tar-gzip') THEN 'archive'
  ELSE 'media' END"""


@query("f9_kind_rollup", f"""
WITH {CATALOGUE_SQL}, k AS (SELECT batch, format_id, {KIND_SQL} AS kind FROM detected)
SELECT batch, count(*) AS files, count(DISTINCT kind) AS kinds, bool_and(format_id IS NOT NULL) AS all_known,
  CASE WHEN count(DISTINCT kind) = 1 AND bool_and(format_id IS NOT NULL) THEN min(kind)
       WHEN bool_and(format_id IS NOT NULL) AND count(*) > 1 THEN 'batch' ELSE 'archive-build' END AS kind
FROM k GROUP BY batch
""")
def kinds(spark, t):
    return formats.rollup_kinds(detected(t))


@query("f1_registry_usage", f"""
WITH {CATALOGUE_SQL} SELECT format_id, count(*) AS files FROM detected WHERE format_id IS NOT NULL GROUP BY format_id
""")
def registry_usage(spark, t):
    """Files per registered format (the registry table itself holds 86 rows)."""
    used = detected(t).groupBy("format_id").agg(F.count(F.lit(1)).alias("files"))
    return used.join(F.broadcast(formats.format_registry(spark)), "format_id").select("format_id", "files")


def _edges_sql() -> str:
    """The edge table as SQL, written out of the family list."""
    selects = []
    for i, f in enumerate(routes.FAMILIES):
        values = []
        for a, s in enumerate(f.inputs):
            for b, (o, q) in enumerate(f.outputs.items()):
                if f.engine == "vips-image" and s in routes.NATIVE_IMAGES and o in routes.NATIVE_IMAGES:
                    continue
                meta = f.metadata
                if f.engine == "vips-image" and s == "heic":
                    meta = routes.HEIC_LOSS
                if f.engine == "subtitle-compat" and s == "ass" and o != "ass":
                    meta = routes.ASS_LOSS
                quality = q if s != o or "image" in f.engine else f.same
                price = f.cost_of.get(o, f.cost)
                stream = f.streams in ("all", o)
                score = price + quality * 1000 + 25 * len(meta) + 5 * f.memory + (0 if stream else 8)
                values.append(f"({i * 1000 + a * 30 + b}, '{s}', '{o}', '{f.engine}', {round(float(score), 4)}, {f.root_only}, "
                              f"{len(meta)}, {float(quality)})")
        selects.append(", ".join(values))
    return ("edges(eo, s, t, conv, cost, root_only, n_meta, quality) AS (VALUES " + ", ".join(selects) + ")")


EDGES_SQL = _edges_sql()
ROUNDS = 5
REACH_SQL = """
r0 AS (SELECT DISTINCT s AS src, s AS node FROM edges)""" + "".join(f""",
r{i + 1} AS (SELECT * FROM r{i} UNION SELECT src, e.t FROM r{i} JOIN edges e ON e.s = node WHERE NOT root_only OR node = src)"""
                                                                  for i in range(ROUNDS)) + f""",
closure AS (SELECT DISTINCT src AS source, e.t AS target FROM r{ROUNDS} JOIN edges e ON e.s = node
  WHERE NOT root_only OR node = src)"""


@query("r1_edges_per_file", f"""
WITH {CATALOGUE_SQL}, {EDGES_SQL}
SELECT page_id, count(e.t) AS edges, count(DISTINCT e.t) AS targets, count(*) FILTER (WHERE e.quality > 0) AS lossy,
       coalesce(sum(e.n_meta), 0) AS metadata
FROM detected LEFT JOIN edges e ON e.s = format_id GROUP BY page_id
""")
def edges_per_file(spark, t):
    per = routes.conversion_edges(spark).groupBy(F.col("source").alias("format_id")).agg(
        F.count("target").alias("edges"), F.count_distinct("target").alias("targets"),
        F.count_if(F.col("quality_loss") > 0).alias("lossy"), F.sum(F.size("metadata_loss")).alias("metadata"))
    return detected(t).select("page_id", "format_id").join(F.broadcast(per), "format_id", "left").na.fill(0).select(
        "page_id", "edges", "targets", "lossy", "metadata")


@query("r2_available_targets", f"""
WITH {CATALOGUE_SQL}, {EDGES_SQL}, {REACH_SQL}
SELECT page_id, target FROM detected JOIN closure ON source = format_id
""")
def targets(spark, t):
    reach = routes.available_targets(routes.conversion_edges(spark))
    return detected(t).select("page_id", F.col("format_id").alias("source")).join(F.broadcast(reach), "source").select(
        "page_id", "target")


@query("r3_common_targets", f"""
WITH {CATALOGUE_SQL}, {EDGES_SQL}, {REACH_SQL},
d AS (SELECT DISTINCT page_id % 16 AS batch, fid AS format_id FROM c2),
b AS (SELECT batch, count(*) AS n, bool_and(format_id IS NOT NULL) AS known FROM d GROUP BY batch)
SELECT batch, target FROM d JOIN closure ON source = format_id JOIN b USING (batch) WHERE known
GROUP BY batch, target, n HAVING count(*) = n
""")
def shared_targets(spark, t):
    files = formats.detect_formats(catalogue(t)).withColumn("batch", F.col("page_id") % 16)
    return routes.common_targets(routes.conversion_edges(spark), files)


def _best_sql(rounds: int) -> str:
    """Cheapest cost from every source by unrolled relaxation."""
    text = "b0 AS (SELECT DISTINCT s AS src, s AS node, 0.0::DOUBLE AS score FROM edges)"
    for i in range(rounds):
        text += f""",
b{i + 1} AS (SELECT src, node, min(score) AS score FROM (SELECT * FROM b{i} UNION ALL
  SELECT src, e.t, round(score + cost, 4) FROM b{i} JOIN edges e ON e.s = node WHERE (NOT root_only OR node = src) AND e.t <> src)
  GROUP BY src, node)"""
    return text + f""",
best AS (SELECT src, node, score FROM b{rounds} WHERE src <> node UNION ALL
  SELECT s, t, min(cost) FROM edges WHERE s = t GROUP BY s, t)"""


@query("r4_cheapest_routes", f"""
WITH {CATALOGUE_SQL}, {EDGES_SQL}, {_best_sql(ROUNDS)}
SELECT page_id, node AS target, score FROM detected JOIN best ON src = format_id
""")
def cheapest(spark, t):
    plan = routes.plan_routes(routes.conversion_edges(spark)).select("source", "target", "score")
    return detected(t).select("page_id", F.col("format_id").alias("source")).join(F.broadcast(plan), "source").select(
        "page_id", "target", "score")


@query("r5_route_losses")
def losses(spark, t):
    """Losses on the way of every file to PDF, JSON or WebVTT, with the engines on the route."""
    plan = routes.plan_routes(routes.conversion_edges(spark), preference="semantic").where(
        F.col("target").isin("pdf", "json-data", "vtt"))
    report = routes.analyze_loss(plan, formats.format_registry(spark)).select(
        "source", "target", F.array_join(F.transform("hops", lambda h: h["converter"]), " > ").alias("converters"),
        F.array_join(F.transform("losses", lambda x: x["code"]), ",").alias("codes"))
    return detected(t).select("page_id", F.col("format_id").alias("source")).join(F.broadcast(report), "source")


# ---- batch ----

def doc_files(t) -> DataFrame:
    """Documents as input files with a dense position."""
    files = t.documents.select("doc_id", F.concat(
        F.lit("in/"), F.col("source"), F.lit("/ my  file."), F.col("doc_id") % 5, F.when(
            F.col("doc_id") % 4 == 0, ".").otherwise(".txt")).alias("source_name"))
    from tablemill.functions.ordering import running_index

    return running_index(files, [], "doc_id", "idx")


@query("b2_render_names", """
WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total,
  ' my  file.' || doc_id % 5 || CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '.txt' END AS base FROM documents),
g AS (SELECT doc_id, n, total, regexp_replace(base, '\\.[^.]*$', '') AS stem,
  regexp_extract(base, '\\.([^.]*)$', 1) AS ext FROM f),
v AS (SELECT doc_id, lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') || '-' || stem || '_' || ext || '_of_' || total
  || '_2024-05-06_docx ' AS raw FROM g)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[. ]+', ''), '[. ]+$', '') || '.docx'
  AS output_name FROM v
""")
def render(spark, t):
    files = doc_files(t)
    total = t.documents.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    with_total = files.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return naming.render_names(with_total, "{index:03}-{name}:{sourceExt}_of_{total}_{date}_{format} ", ".docx", "docx",
                               "2024-05-06").select("doc_id", "output_name")


@query("b3_unique_names", """
SELECT c_custkey, c_mktsegment || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END || '.txt' AS unique_name FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer)
""")
def unique(spark, t):
    names = t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit(".txt")).alias("name"))
    return naming.unique_names(names, "name", "c_custkey").select("c_custkey", "unique_name")


@query("b3_unique_names_contested", """
WITH s AS (SELECT o_orderkey, 'x' || CASE WHEN o_orderkey % 50 = 7 THEN '-' || (o_orderkey * 3 + 2) ELSE '' END AS n FROM orders),
r AS (SELECT *, count(*) FILTER (WHERE n = 'x') OVER (ORDER BY o_orderkey) AS m FROM s)
SELECT count(*) AS files, count(*) AS names, max(m) AS repeats FROM r
""")
def unique_contested(spark, t):
    """One name repeated by nearly all orders, with real numbered names among them: all results must differ."""
    key = F.col("o_orderkey")
    names = t.orders.select("o_orderkey", F.concat(F.lit("x"), F.when(
        key % 50 == 7, F.concat(F.lit("-"), (key * 3 + 2).cast("string"))).otherwise("")).alias("name"))
    done = naming.unique_names(names, "name", "o_orderkey")
    return done.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.lower("unique_name")).alias("names"),
                    F.count_if(F.col("name") == "x").alias("repeats"))


@query("b4_unique_archive_paths", """
SELECT doc_id, source || '/a/doc' || CASE WHEN rn > 1 THEN ' (' || rn || ')' ELSE '' END || '.txt' AS unique_path FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
""")
def unique_paths(spark, t):
    paths = t.documents.select("doc_id", F.concat("source", F.lit("/a/doc.txt")).alias("path"))
    return naming.unique_archive_paths(paths, "path", "doc_id").select("doc_id", "unique_path")


@query("s11_repeat_names", """
SELECT doc_id, lang || '/doc.txt' || CASE WHEN rn > 1 THEN '.' || rn ELSE '' END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)
""")
def repeat_names(spark, t):
    paths = t.documents.select("doc_id", "source", F.concat("lang", F.lit("/doc.txt")).alias("path"))
    return naming.numbered_repeats(paths, ["source"], "path", "doc_id").select("doc_id", "name")


def order_tasks(t) -> DataFrame:
    """Orders as batch tasks."""
    key = F.col("o_orderkey")
    state = (F.when(F.col("o_orderstatus") == "F", F.when(key % 3 == 0, "failed").otherwise("completed"))
             .when(F.col("o_orderstatus") == "O", F.when(key % 2 == 0, "pending").otherwise("cancelled"))
             .otherwise("running"))
    return t.orders.select(
        key.alias("idx"), F.concat(F.lit("order-"), key).alias("source_name"), state.alias("state"),
        ((key % 4) / 4.0).alias("progress"),
        F.when((state == "failed") & (key % 2 == 0), "Cannot plan").otherwise(
            F.concat(F.lit("Step "), (key % 9).cast("string"))).alias("stage"),
        F.when((state == "failed") & (key % 5 != 0), F.concat(F.lit("OUTPUT_INVALID: order "), key)).alias("error"))


TASKS_SQL = """
tasks AS (SELECT o_orderkey AS idx, 'order-' || o_orderkey AS source_name, CASE o_orderstatus
    WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END
    WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'cancelled' END ELSE 'running' END AS state,
  (o_orderkey % 4) / 4.0::DOUBLE AS progress,
  CASE WHEN state = 'failed' AND o_orderkey % 2 = 0 THEN 'Cannot plan' ELSE 'Step ' || o_orderkey % 9 END AS stage,
  CASE WHEN state = 'failed' AND o_orderkey % 5 <> 0 THEN 'OUTPUT_INVALID: order ' || o_orderkey END AS error FROM orders)
"""


@query("b5_batch_snapshot", f"""
WITH {TASKS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE state = 'pending') AS pending,
  count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'completed') AS completed,
  count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'cancelled') AS cancelled,
  round(avg(CASE WHEN state = 'failed' THEN 1.0 ELSE progress END), 10) AS progress,
  bool_or(state IN ('pending', 'cancelled') OR (state = 'failed' AND stage <> 'Cannot plan')) AS resumable,
  count(*) FILTER (WHERE state = 'running') || ' active · ' || (SELECT string_agg(stage, ' · ' ORDER BY idx) FROM (
    SELECT idx, stage FROM tasks WHERE state = 'running' ORDER BY idx LIMIT 2)) AS stage
FROM tasks
""")
def snapshot(spark, t):
    return batch.batch_snapshot(order_tasks(t)).withColumn("progress", F.round("progress", 10))


@query("b6_failures", f"""
WITH {TASKS_SQL} SELECT idx, source_name AS name, coalesce(error, 'Conversion failed.') AS error, TRUE AS cancelled
FROM tasks WHERE state = 'failed'
""")
def failures(spark, t):
    return batch.batch_failures(order_tasks(t))


@query("b7_retry_set", f"""
WITH {TASKS_SQL} SELECT idx, source_name, 'pending' AS state, 0.0::DOUBLE AS progress, 'Queued for resume' AS stage,
  NULL AS error FROM tasks
WHERE state IN ('pending', 'cancelled') OR (state = 'failed' AND stage <> 'Cannot plan')
""")
def retry(spark, t):
    return batch.select_retry(order_tasks(t))


@query("b9_merge_warnings", """
SELECT o_orderkey, concat_ws('|', o_orderstatus, CASE WHEN o_orderpriority <> o_orderstatus THEN o_orderpriority END,
  'x') AS warnings FROM orders
""")
def merged(spark, t):
    a = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    b = F.array(F.lit("x"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.array_join(batch.merge_warnings(a, F.lit(None).cast("array<string>"), b), "|")
                           .alias("warnings"))


def _tags() -> Column:
    return F.create_map(F.lit("title"), F.col("event_type"), F.lit("password"), F.col("props"), F.lit("comment"),
                        F.col("user_id").cast("string"), F.lit("artist"), F.lit("a"))


@query("b10_redact_options", """
SELECT event_id, 'artist,comment,title' AS kept, event_type AS title FROM events
""")
def redact(spark, t):
    kept = t.events.select("event_id", batch.redact_options(_tags()).alias("m"))
    return kept.select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kept"),
                       F.col("m")["title"].alias("title"))


@query("b11_tag_policy", """
SELECT event_id, 'artist=a' || CASE WHEN event_id % 2 = 0 THEN ',genre=' || user_id ELSE '' END || ',title=' || event_type AS privacy,
  '' AS strip, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 4 END AS preserved FROM events
""")
def tags(spark, t):
    """Tags that differ from row to row, under each policy."""
    genre = F.create_map(F.lit("genre"), F.col("user_id").cast("string"))
    held = F.when(F.col("event_id") % 2 == 0, F.map_concat(_tags(), genre)).otherwise(_tags())

    def entries(policy: str) -> Column:
        kept = F.array_sort(F.map_entries(batch.tag_policy(held, policy)))
        return F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.events.select("event_id", entries("privacy").alias("privacy"), entries("strip").alias("strip"),
                           F.size(batch.tag_policy(held, "preserve")).alias("preserved"))


@query("b12_classify_errors", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' OUTPUT_INVALID: bad ' || event_id
  WHEN 'view' THEN 'SOMETHING_NEW:  odd ' || user_id WHEN 'error' THEN 'No local conversion route is available.'
  WHEN 'signup' THEN 'Job cancelled' ELSE CASE WHEN event_id % 2 = 0 THEN '' ELSE 'plain words' END END AS msg FROM events)
SELECT event_id, CASE WHEN msg LIKE '%OUTPUT_INVALID%' THEN 'OUTPUT_INVALID' WHEN msg LIKE 'SOMETHING%' THEN 'SOMETHING_NEW'
  WHEN msg LIKE 'No local%' THEN 'NO_LOCAL_ROUTE' WHEN msg LIKE '%cancel%' THEN 'CANCELLED' END AS code,
  CASE WHEN msg LIKE '%OUTPUT_INVALID%' THEN 'Output validation failed' WHEN msg LIKE 'No local%' THEN 'Conversion unavailable'
  WHEN msg LIKE '%cancel%' THEN 'Conversion cancelled' ELSE 'Conversion could not be completed' END AS title,
  CASE WHEN msg LIKE 'SOMETHING%' THEN 'odd ' || split_part(msg, 'odd ', 2) WHEN msg = 'plain words' THEN msg
  WHEN msg = '' THEN 'The run ended with an error that names no cause.' END AS own_message
FROM e
""")
def classify(spark, t):
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", F.concat(F.lit(" OUTPUT_INVALID: bad "), "event_id"))
        .when(kind == "view", F.concat(F.lit("SOMETHING_NEW:  odd "), "user_id"))
        .when(kind == "error", "No local conversion route is available.")
        .when(kind == "signup", "Job cancelled").when(F.col("event_id") % 2 == 0, "").otherwise("plain words"))
    found = batch.classify_errors(t.events.select("event_id", message.alias("msg")), "msg")
    return found.select("event_id", "code", "title", F.when(
        F.col("title") == "Conversion could not be completed", F.col("message")).alias("own_message"))


# ---- archives ----

def doc_entries(t) -> DataFrame:
    """Documents as entries of archives; several kinds of unsafe, repeated and odd paths and sizes occur."""
    arc = F.col("doc_id") % 60
    raw = (
        F.when((arc % 6 == 0) & (F.col("doc_id") % 5 == 0), F.concat(F.lit("../evil"), "doc_id"))
        .when((arc % 6 == 0) & (F.col("doc_id") % 5 == 1), F.concat(F.lit("/etc/x"), "doc_id"))
        .when((arc % 6 == 0) & (F.col("doc_id") % 5 == 2), F.lit("C:\\Windows\\f.txt"))
        .when((arc % 6 == 0) & (F.col("doc_id") % 5 == 3), F.lit("./."))
        .when(F.col("doc_id") % 7 == 0, F.concat(F.lit("./Folder\\"), "lang", F.lit("//./a.txt")))
        .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("folder/"), "lang", F.lit("/A.txt")))
        .otherwise(F.concat(F.col("source"), F.lit("/"), F.col("doc_id") % 100, F.lit(".txt"))))
    size = F.when(arc % 6 == 1, F.col("n_chars") * 10_000_000).when(arc % 6 == 2, F.col("n_chars") * 20_000).otherwise(
        F.col("n_chars"))
    return t.documents.select(
        arc.alias("archive_id"), F.col("doc_id").alias("idx"), raw.alias("path"), size.alias("size"),
        F.floor(F.col("n_chars") / 4).cast("bigint").alias("compressed_size"),
        (F.col("doc_id") % 10 == 9).alias("directory"), (F.col("doc_id") % 50 == 3).alias("encrypted"))


ENTRIES_SQL = """
entries AS (SELECT doc_id % 60 AS archive_id, doc_id AS idx, CASE
  WHEN doc_id % 60 % 6 = 0 AND doc_id % 5 = 0 THEN '../evil' || doc_id
  WHEN doc_id % 60 % 6 = 0 AND doc_id % 5 = 1 THEN '/etc/x' || doc_id
  WHEN doc_id % 60 % 6 = 0 AND doc_id % 5 = 2 THEN 'C:\\Windows\\f.txt'
  WHEN doc_id % 60 % 6 = 0 AND doc_id % 5 = 3 THEN './.'
  WHEN doc_id % 7 = 0 THEN './Folder\\' || lang || '//./a.txt'
  WHEN doc_id % 7 = 1 THEN 'folder/' || lang || '/A.txt'
  ELSE source || '/' || doc_id % 100 || '.txt' END AS raw,
  CASE doc_id % 60 % 6 WHEN 1 THEN n_chars * 10000000 WHEN 2 THEN n_chars * 20000 ELSE n_chars END AS size,
  n_chars // 4 AS compressed_size, doc_id % 10 = 9 AS directory, doc_id % 50 = 3 AS encrypted FROM documents),
safe AS (SELECT *, replace(raw, '\\', '/') AS slashed, CASE
  WHEN slashed LIKE '/%' OR regexp_matches(slashed, '^[A-Za-z]:/') THEN 'ARCHIVE_PATH_UNSAFE: Absolute archive path is blocked.'
  WHEN slashed LIKE '../%' THEN 'ARCHIVE_PATH_UNSAFE: Parent-directory traversal is blocked.'
  WHEN slashed = './.' THEN 'ARCHIVE_PATH_UNSAFE: Empty entry path.' END AS path_error,
  CASE WHEN path_error IS NULL THEN regexp_replace(replace(replace(slashed, '/./', '/'), '//', '/'), '^\\./', '') END AS path
  FROM entries)
"""
FILES_SQL = "files AS (SELECT DISTINCT doc_id % 60 AS archive_id, 1000 + doc_id % 60 AS source_bytes FROM documents)"


def doc_archives(t) -> DataFrame:
    return t.documents.select((F.col("doc_id") % 60).alias("archive_id")).distinct().withColumn(
        "source_bytes", F.col("archive_id") + 1000)


@query("a1_normalize_paths", f"WITH {ENTRIES_SQL} SELECT archive_id, idx, path, path_error FROM safe")
def normalize(spark, t):
    return archive.normalize_paths(doc_entries(t)).select("archive_id", "idx", "path", "path_error")


@query("a2_archive_verdict", f"""
WITH {ENTRIES_SQL}, {FILES_SQL},
bad AS (SELECT archive_id, min(idx) AS bad_at, arg_min(path_error, idx) AS why FROM safe WHERE path_error IS NOT NULL GROUP BY 1),
tot AS (SELECT archive_id, count(*) AS entries, sum(size) AS expanded_size FROM entries GROUP BY 1),
pre AS (SELECT e.archive_id, sum(size) AS before_bad FROM entries e JOIN bad b ON b.archive_id = e.archive_id AND idx < bad_at GROUP BY e.archive_id),
dup AS (SELECT archive_id, sum(n - 1) AS duplicates FROM (SELECT archive_id, path, count(*) AS n FROM safe
  WHERE path_error IS NULL GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT f.*, entries, expanded_size, expanded_size / source_bytes AS ratio, coalesce(duplicates, 0) AS duplicates, why,
  coalesce(before_bad, 0) AS before_bad FROM files f LEFT JOIN tot USING (archive_id) LEFT JOIN bad USING (archive_id)
  LEFT JOIN pre USING (archive_id) LEFT JOIN dup USING (archive_id))
SELECT archive_id, entries, CAST(expanded_size AS BIGINT) AS expanded_size, round(ratio, 6) AS ratio,
  CAST(duplicates AS BIGINT) AS duplicates, CASE
  WHEN why IS NOT NULL AND before_bad <= 17179869184 THEN why
  WHEN expanded_size > 17179869184 THEN 'ARCHIVE_EXPANDED_LIMIT: Declared expanded archive size exceeds the safety limit.'
  WHEN expanded_size > 67108864 AND ratio > 1000 THEN 'ARCHIVE_BOMB_SUSPECTED: Declared expansion ratio is unsafe.' END AS error
FROM v
""")
def verdict(spark, t):
    return archive.assess_archives(doc_entries(t), doc_archives(t)).select(
        "archive_id", "entries", "expanded_size", F.round("ratio", 6).alias("ratio"), "duplicates", "error")


@query("a3_duplicate_paths", f"""
WITH {ENTRIES_SQL} SELECT archive_id, idx, path FROM safe WHERE path_error IS NULL
QUALIFY row_number() OVER (PARTITION BY archive_id, path ORDER BY idx) > 1
""")
def duplicates(spark, t):
    safe = archive.normalize_paths(doc_entries(t)).where("path_error IS NULL")
    return archive.duplicate_paths(safe).select("archive_id", "idx", "path")


@query("a4_case_collisions", f"""
WITH {ENTRIES_SQL}, f AS (SELECT archive_id, idx, path, first_value(path) OVER (
  PARTITION BY archive_id, lower(path) ORDER BY idx) AS prior FROM safe WHERE path_error IS NULL)
SELECT * FROM f WHERE path <> prior
""")
def collisions(spark, t):
    safe = archive.normalize_paths(doc_entries(t)).where("path_error IS NULL")
    return archive.case_collisions(safe).select("archive_id", "idx", "path", "prior")


@query("a5_package_verdict", f"""
WITH {ENTRIES_SQL}, u AS (SELECT *, regexp_matches(raw, '^(?:[/\\\\]|[A-Za-z]:[/\\\\])') OR list_contains(
  string_split(slashed, '/'), '..') AS unsafe FROM safe)
SELECT archive_id, count(*) AS entries, count(*) FILTER (WHERE unsafe) AS unsafe_names,
  sum(size) <= 8589934592 AND sum(size) / sum(compressed_size) <= 500 AND count(*) FILTER (WHERE unsafe) = 0 AS safe,
  concat_ws(' ', 'A member name leaves the package: ' || arg_min(raw, idx) FILTER (WHERE unsafe),
   CASE WHEN count(*) <> 17 THEN 'The number of members differs from the one that the directory states.' END,
   CASE WHEN sum(size) > 8589934592 OR sum(size) / sum(compressed_size) > 500
     THEN 'The package would grow beyond the allowed size or ratio.' END) AS warnings
FROM u GROUP BY archive_id
""")
def package_verdict(spark, t):
    declared = doc_archives(t).select("archive_id", F.lit(17).alias("declared_entries"))
    return archive.assess_packages(doc_entries(t), declared).select(
        "archive_id", "entries", "unsafe_names", "safe", F.array_join("warnings", " ").alias("warnings"))


@query("a6_extraction_budget", f"""
WITH {ENTRIES_SQL}
SELECT archive_id, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files, CASE
  WHEN sum(size) > 134217728 THEN 'ARCHIVE_EXTRACTION_BUDGET: The chosen members hold more than 128 MiB.'
  WHEN count(*) > 15 THEN 'ARCHIVE_EXTRACTION_BUDGET: Too many files for one extraction result.' END AS error
FROM entries WHERE NOT directory GROUP BY archive_id
""")
def budget(spark, t):
    return archive.extraction_budget(doc_entries(t), 128 * 1024 * 1024, 15)


@query("a7_ustar_split", """
WITH p AS (SELECT page_id, regexp_replace(replace(CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1
  THEN repeat('folder/', 14) || url WHEN page_id % 4 = 2 THEN repeat('x', 260) ELSE '/a/' || page_id || '/' END, '\\', '/'),
  '^/+|/+$', '', 'g') AS path FROM pages),
c AS (SELECT page_id, path, unnest(range(1, greatest(len(string_split(path, '/')), 2))) AS i FROM p),
s AS (SELECT page_id, i, array_to_string(string_split(path, '/')[i + 1:], '/') AS name,
  array_to_string(string_split(path, '/')[:i], '/') AS prefix, path FROM c),
b AS (SELECT page_id, arg_max(name, i) AS name, arg_max(prefix, i) AS prefix FROM s
  WHERE contains(path, '/') AND strlen(prefix) <= 155 AND strlen(name) <= 100 GROUP BY page_id)
SELECT p.page_id, CASE WHEN strlen(path) <= 100 THEN path ELSE name END AS name,
  CASE WHEN strlen(path) <= 100 THEN '' ELSE prefix END AS prefix,
  CASE WHEN strlen(path) > 100 AND name IS NULL THEN 'TAR_PATH_TOO_LONG: Path cannot be represented safely in USTAR.' END AS error
FROM p LEFT JOIN b USING (page_id)
""")
def ustar(spark, t):
    from tablemill.functions.text import ustar_split

    k = F.col("page_id")
    path = (F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit("folder/" * 14), F.col("url")))
            .when(k % 4 == 2, F.lit("x" * 260)).otherwise(F.concat(F.lit("/a/"), k, F.lit("/"))))
    return t.pages.select("page_id", ustar_split(path).alias("s")).select("page_id", "s.*")


@query("i7_archive_summary", f"""
WITH {ENTRIES_SQL}, {FILES_SQL}
SELECT archive_id, count(*) FILTER (WHERE NOT directory) AS files, count(*) FILTER (WHERE directory) AS directories,
  CAST(sum(size) AS BIGINT) AS expanded_size, bool_or(encrypted) AS encrypted, bool_or(encrypted) AS password_required,
  round(sum(size) / any_value(source_bytes), 6) AS compression_ratio
FROM entries JOIN files USING (archive_id) GROUP BY archive_id
""")
def archive_summary(spark, t):
    return archive.inspect_archives(doc_entries(t), doc_archives(t)).select(
        "archive_id", "files", "directories", "expanded_size", "encrypted", "password_required",
        F.round("compression_ratio", 6).alias("compression_ratio"))


# ---- whole runs ----

@query("b1_run_corpus", " UNION ALL ".join(f"""
SELECT '{n}.parquet' AS source_name, 'parquet' AS format_id, 'completed' AS state, 'Complete' AS stage, '{n}.csv' AS output_name,
  (SELECT count(*) FROM {n}) AS rows, NULL AS error""" for n in sorted(TABLES)))
def run_tables(spark, t):
    """All given tables, found by content and written as CSV under names from a template."""
    from tablemill.plans.run import run_corpus

    done = run_corpus(spark, [t.path(n) for n in TABLES], "csv", work_path(spark, "out"), {"template": "{name}"})
    return done.select("source_name", "format_id", "state", "stage", "output_name", "rows", "error")


@query("b8_resumable_intake", """
SELECT DISTINCT event_type, TRUE AS each_once, 'jsonl' AS format_id FROM events
""")
def intake(spark, t):
    """Events arrive as JSON Lines files in two deliveries; the second run must take the new files only."""
    inbox, out, checkpoint = (work_path(spark, n) for n in ("inbox", "catalogue", "progress"))
    late = F.col("event_type").isin("click", "view")
    for delivery in (t.events.where(~late), t.events.where(late)):
        delivery.withColumn("kind", F.col("event_type")).write.mode("append").partitionBy("kind").json(inbox)
        ingest_available(spark, inbox, out, checkpoint).awaitTermination()
    seen = spark.read.parquet(out).withColumn("event_type", F.regexp_extract("path", "kind=([a-z]+)/", 1))
    return seen.groupBy("event_type").agg(
        (F.count(F.lit(1)) == F.count_distinct("path")).alias("each_once"), F.max("format_id").alias("format_id"))


@query("b8_intake_by_content", """
SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'known' ELSE 'new' END AS status, 1 AS run FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'new', 0 FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type
""")
def intake_of_copies(spark, t):
    """Two deliveries; what the first one held comes again under other names."""
    inbox, out, state = (work_path(spark, n) for n in ("inbox", "taken", "state"))
    first = t.events.where(F.col("event_type").isin("click", "view"))
    # one file for each type, so a delivery's files are the same whenever it is written
    for folder, rows in (("one", first), ("two", t.events)):
        lines = rows.select("event_type", F.to_json(F.struct("event_id", "user_id", "value")).alias("value"), F.col("event_type").alias("kind"), "event_id")
        lines.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("value", "kind").write.partitionBy("kind").text(
            f"{inbox}/{folder}")
        intake_by_content(spark, inbox, out, state)
    seen = spark.read.schema(by_content.STATE).parquet(state).where("path LIKE '%/part-%'")
    return seen.select(F.regexp_extract("path", "kind=([a-z]+)/", 1).alias("event_type"), "status", "run")
