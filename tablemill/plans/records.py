"""Queries over subtitles, pages, meshes, scientific headers, books, documents and packages made from the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.ordering import running_index
from tablemill.functions.tables import spread
from tablemill.functions.text import clean_ass, match_values, xml_value
from tablemill.operators import archive, inspect, mesh, packages, pages, science, subtitles, validate
from tablemill.plans.registry import query
from tablemill.sources import files as sources

# ---- subtitles: a turn of a conversation is a cue ----


def cues(t) -> DataFrame:
    raw = t.conversations.select(
        F.col("conv_id").alias("doc_id"), "turn", (F.col("turn") * 3_723_456 + F.col("conv_id") * 7).alias("start_ms"),
        (F.col("turn") * 3_723_456 + F.col("conv_id") * 7 + 1_505).alias("end_ms"),
        F.concat(F.col("role"), F.lit(": "), F.regexp_replace("text", r"\s*\n\s*", "\n"))
        .alias("text"))
    return running_index(raw, ["doc_id"], "turn", "pos").withColumn("text", F.trim("text"))


CUES_SQL = """cues AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  turn * 3723456 + conv_id * 7 AS start_ms, turn * 3723456 + conv_id * 7 + 1505 AS end_ms,
  trim(role || ': ' || regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g'), ' ') AS text FROM conversations),
norm AS (SELECT doc_id, pos, start_ms, end_ms, trim(text, ' ' || chr(10) || chr(9)) AS text FROM cues)"""

CLOCK_SQL = """lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' ||
 lpad(({ms} % 60000 // 1000)::VARCHAR, 2, '0') || '{dot}' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"""


def clock_sql(ms: str, dot: str) -> str:
    return CLOCK_SQL.format(ms=ms, dot=dot)


def whole(parts: DataFrame, key: str) -> DataFrame:
    """The parts of small files put together."""
    piece = F.struct(*[c for c in ("section", "part") if c in parts.columns], "text")
    return parts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(piece))["text"], "").alias("text"))


@query("t5_serialize_srt", f"""
WITH {CUES_SQL} SELECT doc_id, string_agg((pos + 1) || chr(10) || {clock_sql('start_ms', ',')} || ' --> ' ||
  {clock_sql('end_ms', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS text FROM norm GROUP BY doc_id
""")
def serialize_srt(spark, t):
    return whole(subtitles.serialize_cues(cues(t), "srt"), "doc_id")


@query("t5_serialize_vtt", f"""
WITH {CUES_SQL} SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({clock_sql('start_ms', '.')} || ' --> ' ||
  {clock_sql('end_ms', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS text FROM norm GROUP BY doc_id
""")
def serialize_vtt(spark, t):
    return whole(subtitles.serialize_cues(cues(t), "vtt"), "doc_id")


@query("t5_serialize_ass", f"""
WITH {CUES_SQL}, c AS (SELECT doc_id, pos, text, (start_ms + 5) // 10 AS s, (end_ms + 5) // 10 AS e FROM cues)
SELECT doc_id, '{subtitles.ASS_HEAD}' || string_agg('Dialogue: 0,' ||
  s // 360000 || ':' || lpad((s % 360000 // 6000)::VARCHAR, 2, '0') || ':' || lpad((s % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((s % 100)::VARCHAR, 2, '0') || ',' ||
  e // 360000 || ':' || lpad((e % 360000 // 6000)::VARCHAR, 2, '0') || ':' || lpad((e % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((e % 100)::VARCHAR, 2, '0') ||
  ',Default,,0,0,0,,' || replace(text, chr(10), '\\N') || chr(10), '' ORDER BY pos) AS text FROM c GROUP BY doc_id
""")
def serialize_ass(spark, t):
    return whole(subtitles.serialize_cues(cues(t), "ass"), "doc_id")


@query("t1_parse_srt", f"WITH {CUES_SQL} SELECT * FROM norm")
def parse_srt(spark, t):
    return subtitles.parse_srt(serialize_srt(spark, t))


@query("t2_parse_vtt", f"WITH {CUES_SQL} SELECT * FROM norm")
def parse_vtt(spark, t):
    noted = serialize_vtt(spark, t).withColumn("text", F.concat(
        F.lit("WEBVTT Kind: captions\r\n\r\nNOTE a --> b\nnot a cue\n\nSTYLE\n::cue {}\n\n"),
        F.regexp_replace(F.substring("text", 9, 1 << 30), r"(\d{3})(\n)", "$1 align:start$2")))
    return subtitles.parse_vtt(noted.withColumn("text", F.regexp_replace("text", r"(-->[^\n]*?)(?: align:start)+", "$1 align:start")))


@query("t3_parse_ass", f"""
WITH {CUES_SQL} SELECT doc_id, pos, (start_ms + 5) // 10 * 10 AS start_ms, (end_ms + 5) // 10 * 10 AS end_ms, text FROM norm
""")
def parse_ass(spark, t):
    return subtitles.parse_ass(serialize_ass(spark, t))


@query("t4_clean_ass", """
SELECT conv_id, turn, role || chr(10) || ' ' || rtrim(text, ' ' || chr(10)) AS text FROM conversations
""")
def clean(spark, t):
    raw = F.concat(F.lit("{\\b1}"), "role", F.lit("\\N\\h{\\i0\\k}"), "text", F.lit("  "))
    return t.conversations.select("conv_id", "turn", clean_ass(raw).alias("text"))


@query("t6_translate_srt_to_vtt", f"""
WITH {CUES_SQL} SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({clock_sql('start_ms', '.')} || ' --> ' ||
  {clock_sql('end_ms', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS text FROM norm GROUP BY doc_id
""")
def translate(spark, t):
    return whole(subtitles.translate_subtitles(serialize_srt(spark, t), "srt", "vtt"), "doc_id")


# ---- pages ----

def conversation_pages(t) -> DataFrame:
    """Every turn is a page; a nearly empty one follows after every third."""
    turns = t.conversations.select(F.col("conv_id").alias("doc"), (2 * F.col("turn") + 1).alias("page"), "text")
    return turns.unionByName(turns.where(F.col("page") % 6 == 5).select("doc", F.col("page") + 1, F.lit("  x ").alias("text")).toDF(
        "doc", "page", "text"))


PAGES_SQL = """pages_ AS (SELECT conv_id AS doc, 2 * turn + 1 AS page, text FROM conversations
  UNION ALL SELECT conv_id, 2 * turn + 2, '  x ' FROM conversations WHERE turn % 3 = 2)"""


@query("i16_page_coverage", f"""
WITH {PAGES_SQL}, c AS (SELECT doc, length(trim(text, ' ' || chr(10))) AS n FROM pages_)
SELECT doc, count(*) AS pages, count(*) FILTER (WHERE n >= 5) AS text_pages, count(*) FILTER (WHERE n < 5) AS scanned_pages,
  CAST(sum(n) AS BIGINT) AS chars, text_pages > 0 AND scanned_pages > 0 AS mixed,
  CASE WHEN mixed THEN 'mixed' WHEN text_pages > 0 THEN 'text' ELSE 'scanned' END AS kind FROM c GROUP BY doc
""")
def coverage(spark, t):
    return inspect.page_coverage(conversation_pages(t))


@query("p2_assemble_text", f"""
WITH {PAGES_SQL} SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc
""")
def assemble(spark, t):
    return whole(pages.assemble_pages(conversation_pages(t)), "doc")


@query("p2_assemble_markdown", f"""
WITH {PAGES_SQL} SELECT doc, string_agg('<!-- Page ' || page || ' -->' || chr(10) || chr(10) || trim(text, ' ' || chr(10)),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc
""")
def assemble_markdown(spark, t):
    return whole(pages.assemble_pages(conversation_pages(t), "markdown"), "doc")


@query("p1_reconstruct_lines", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
r AS (SELECT doc_id AS doc, CAST(i // 400 AS BIGINT) AS page, i % 400 // 8 AS row, i % 8 AS col,
  regexp_replace(w, '\\s+', ' ', 'g') AS w FROM w WHERE w <> '')
SELECT doc, page, row AS line, trim(regexp_replace(string_agg(w, ' ' ORDER BY col), '\\s+', ' ', 'g'), ' ') AS text
FROM r GROUP BY doc, page, row
""")
def reconstruct(spark, t):
    """Words of the documents placed eight to a line, given in a scrambled order."""
    words = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", " ")).alias("i", "str"))
    runs = words.select(
        "doc", F.floor(F.col("i") / 400).cast("bigint").alias("page"), F.pmod(F.col("i") * 7919, F.lit(100_003)).alias("seq"),
        ((F.col("i") % 8) * 60.0).alias("x"),
        (800.0 - F.floor(F.col("i") % 400 / 8) * 12 + (F.col("i") % 2) * 0.75).alias("y"), "str")
    lines = pages.reconstruct_lines(runs)
    # the line number follows from the height it was placed at
    return lines.select("doc", "page", F.floor((801 - F.col("y")) / 12).cast("bigint").alias("line"), "text")


SPECS = ["1-3,5,9-7", "all", "", "2,2,1", "4-x", "3-40", " 2 ; 5-4 ;", ",", "0", "1-2,1-3"]


@query("p3_page_specs", """
WITH s AS (SELECT doc_id, [[[1,2,3,5,9,8,7]], [[1,2,3,4,5,6,7,8,9,10]], [[1,2,3,4,5,6,7,8,9,10]], [[2,1]], [[0]], [[-1]], [[2],[5,4]], [[-2]], [[-3]],
  [[1,2,3]]][doc_id % 10 + 1] AS g, 9 + doc_id % 2 AS n FROM documents),
p AS (SELECT doc_id, n, unnest(g) AS pages, generate_subscripts(g, 1) AS part FROM s),
e AS (SELECT doc_id, n, part, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS pos FROM p)
SELECT doc_id, CAST(part AS INTEGER) AS part, CASE WHEN page > 0 THEN CAST(pos AS INTEGER) END AS pos,
  CASE WHEN page > 0 THEN CAST(page AS BIGINT) END AS page, CASE page
  WHEN 0 THEN 'PDF_PAGE_RANGE_INVALID: Invalid page token 4-x'
  WHEN -1 THEN 'PDF_PAGE_RANGE_INVALID: Page ' || n + 1 || ' is outside 1-' || n || '.'
  WHEN -2 THEN 'PDF_PAGE_RANGE_INVALID: No pages selected.'
  WHEN -3 THEN 'PDF_PAGE_RANGE_INVALID: Page 0 is outside 1-' || n || '.' END AS error
FROM e WHERE page <= n
""")
def page_specs(spark, t):
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (F.col("doc_id") % 10 + 1).cast("int"))
    docs = t.documents.select("doc_id", spec.alias("spec"), (F.col("doc_id") % 2 + 9).alias("n"))
    return pages.expand_page_specs(docs, "spec", "n").select("doc_id", "part", "pos", "page", "error")


# ---- meshes: an order is a mesh, its lines are the points of a strip ----

def line_points(t) -> DataFrame:
    points = t.lineitem.select(
        F.col("l_orderkey").alias("mesh_id"), "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"), (F.col("l_extendedprice") / 4).alias("z"))
    # line numbers of an order are unique together with part and price; the position is their rank
    from pyspark.sql import Window

    w = Window.partitionBy("mesh_id").orderBy("l_linenumber", "l_partkey", "z")
    return points.select("mesh_id", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), "x", "y", "z")


def strip(vertices: DataFrame) -> DataFrame:
    i = F.col("idx")
    return vertices.where(i >= 2).select("mesh_id", (i - 2).alias("idx"), (i - 2).alias("a"), (i - 1).alias("b"), i.alias("c"))


MESH_SQL = """pts AS (SELECT l_orderkey AS mesh_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_extendedprice) - 1 AS idx, l_quantity AS x, l_discount AS y, l_extendedprice / 4 AS z FROM lineitem),
big AS (SELECT mesh_id, max(idx) + 1 AS n FROM pts GROUP BY mesh_id HAVING max(idx) >= 2),
tris AS (SELECT mesh_id, idx - 2 AS idx, idx - 2 AS a, idx - 1 AS b, idx AS c FROM pts WHERE idx >= 2)"""


def obj_text(t) -> DataFrame:
    points = line_points(t)
    return whole(mesh.serialize_mesh(points, strip(points), "obj"), "mesh_id")


@query("m1_obj_vertices", f"WITH {MESH_SQL} SELECT mesh_id, idx, x, y, z FROM pts JOIN big USING (mesh_id)")
def obj_vertices(spark, t):
    return mesh.parse_obj(obj_text(t))[0]


@query("m1_obj_triangles", f"WITH {MESH_SQL} SELECT mesh_id, idx, a, b, c FROM tris")
def obj_triangles(spark, t):
    """Faces written with negative and slashed references and, for each mesh, one quad more where it has four points."""
    docs = obj_text(t).withColumn("text", F.regexp_replace("text", r"(?m)^f (\d+) (\d+) (\d+)$", "f $1/7/1 $2//3 $3"))
    return mesh.parse_obj(docs)[1]


@query("m3_ply_vertices", f"WITH {MESH_SQL} SELECT mesh_id, idx, x, y, z FROM pts JOIN big USING (mesh_id)")
def ply_vertices(spark, t):
    points = line_points(t)
    return mesh.parse_ply(whole(mesh.serialize_mesh(points, strip(points), "ply"), "mesh_id"))[0]


@query("m3_ply_triangles", f"WITH {MESH_SQL} SELECT mesh_id, idx, a, b, c FROM tris")
def ply_triangles(spark, t):
    points = line_points(t)
    return mesh.parse_ply(whole(mesh.serialize_mesh(points, strip(points), "ply"), "mesh_id"))[1]


@query("m2_m4_stl_round_trip", f"""
WITH {MESH_SQL}, c AS (SELECT mesh_id, idx * 3 + k AS idx, [a, b, c][k + 1] AS v FROM tris, (SELECT unnest([0, 1, 2]) AS k))
SELECT c.mesh_id, c.idx, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y,
  CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM c JOIN pts p ON p.mesh_id = c.mesh_id AND p.idx = v
""")
def stl(spark, t):
    points = line_points(t)
    parts = mesh.serialize_mesh(points, strip(points), "stl")
    piece = F.struct("section", "part", F.hex("content").alias("h"))
    files = parts.groupBy("mesh_id").agg(F.unhex(F.array_join(F.transform(
        F.array_sort(F.collect_list(piece)), lambda p: p["h"]), "")).alias("content"))
    return mesh.parse_stl(files)[0]


@query("m5_mesh_guard", f"""
WITH {MESH_SQL}, v AS (SELECT mesh_id, count(*) AS vertices FROM pts GROUP BY mesh_id),
t AS (SELECT mesh_id, count(*) AS triangles FROM tris GROUP BY mesh_id)
SELECT mesh_id, vertices, coalesce(triangles, 0) AS triangles, CASE WHEN mesh_id % 9 = 0 AND triangles IS NOT NULL THEN 'MESH_FACE_INVALID: Face index is out of range.'
  WHEN vertices > 6 THEN 'MESH_COMPLEXITY_LIMIT: Mesh exceeds the guarded vertex limit.'
  WHEN triangles IS NULL THEN 'MESH_PARSE_FAILED: No triangle geometry.' END AS error
FROM v LEFT JOIN t USING (mesh_id)
""")
def guard(spark, t):
    points = line_points(t)
    faces = strip(points).withColumn("c", F.when(F.col("mesh_id") % 9 == 0, F.col("c") + 100).otherwise(F.col("c")))
    return mesh.mesh_guard(points, faces, 6, 100)


# ---- FITS, previews, books ----

def fits_files(t) -> DataFrame:
    def card(key: str, value: Column) -> Column:
        return F.rpad(F.concat(F.lit(f"{key:<8}= "), value), 80, " ")
    header = F.concat(
        card("SIMPLE", F.lit("                   T / conforms")), card("PARTKEY", F.concat(F.col("p_partkey").cast("string"), F.lit(" / key"))),
        card("NAME", F.concat(F.lit("'a/b "), "p_name", F.lit("' / its name"))),
        F.rpad(F.concat(F.lit("COMMENT  brand "), "p_brand"), 80, " "), F.lit(" " * 80),
        card("SIZE", F.col("p_size").cast("string")), F.rpad(F.lit("END"), 80, " "))
    return t.part.select(F.col("p_partkey").alias("path"), F.encode(F.rpad(header, 2880, " "), "UTF-8").alias("content"))


@query("x1_fits_cards", """
SELECT p_partkey AS path, idx, ['SIMPLE', 'PARTKEY', 'NAME', 'COMMENT', 'SIZE'][idx + 1] AS keyword,
  ['T', p_partkey::VARCHAR, '''a/b ' || p_name || '''', 'brand ' || p_brand, p_size::VARCHAR][idx + 1] AS value,
  ['conforms', 'key', 'its name', NULL, NULL][idx + 1] AS comment
FROM part, (SELECT unnest(range(5)) AS idx)
""")
def fits(spark, t):
    return science.fits_cards(fits_files(t))


@query("x2_embedded_jpeg", """
SELECT p_partkey AS path, CASE WHEN p_size % 5 <> 0 THEN 10 + 6 + p_size * 20 % 7 END AS "offset",
  CASE WHEN p_size % 5 <> 0 THEN 5 + 40 * p_size END AS length,
  CASE WHEN p_size % 5 = 0 OR 5 + 40 * p_size < 1024 THEN 'RAW_PREVIEW_NOT_FOUND: No usable embedded JPEG preview was found.' END AS error
FROM part
""")
def previews(spark, t):
    """A short preview, a gap, the long preview; every fifth file holds starts only."""
    gap = F.repeat(F.lit("00"), (F.col("p_size") * 20 % 7).cast("int"))
    long = F.concat(F.lit("FFD8FF"), F.repeat(F.lit("11"), F.col("p_size") * 40), F.lit("FFD9"))
    body = F.concat(F.lit("00" * 10), F.lit("FFD8FF00FFD9"), gap, long, F.lit("FFD8FF0000"))
    broken = F.concat(F.lit("FFD8FF0000"), gap, F.lit("FFD8FF1111"))
    files = t.part.select(F.col("p_partkey").alias("path"),
                          F.unhex(F.when(F.col("p_size") % 5 == 0, broken).otherwise(body)).alias("content"))
    return science.largest_embedded_jpeg(files)


def book_files(t) -> DataFrame:
    def xml(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><FictionBook xmlns="http://x"><description><title-info><author>'
              "<first-name>Ann</first-name><last-name>O &amp; B</last-name></author><book-title>Part "), F.col("p_partkey"),
        F.lit("</book-title></title-info></description><body><section><title><p>"), xml(F.col("p_type")),
        F.lit("</p></title><p>"), xml(F.col("p_name")), F.lit(" <i>it</i></p><empty-line/><subtitle>"), xml(F.col("p_brand")),
        F.lit("</subtitle><p>  </p></section></body></FictionBook>"))
    return t.part.select(F.col("p_partkey").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query("x3_fb2_html", """
SELECT p_partkey AS path, '<!doctype html><html><head><meta charset="utf-8"><title>Part ' || p_partkey ||
 '</title></head><body><h1>Part ' || p_partkey || '</h1><p>Ann O &amp; B</p><h2>' || p_type || '</h2>' || chr(10) || '<p>' ||
 p_name || ' it</p>' || chr(10) || '<br>' || chr(10) || '<h3>' || p_brand || '</h3></body></html>' AS text FROM part
""")
def books(spark, t):
    return whole(science.fb2_html(science.fb2_blocks(book_files(t))), "path")


# ---- documents ----

@query("i8_html_profile", """
WITH h AS (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN chr(10) || ' ' || chr(10) ||
  '<TABLE><tr><td><img src="http://x/a.png"><a href = ''ftp://y''></table><h2>x</h2>' ELSE '' END AS html FROM pages)
SELECT page_id, len(list_filter(regexp_split_to_array(html, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(10)) <> '')) AS paragraphs,
  len(regexp_extract_all(html, '(?i)<h[1-6](?:\\s|>)')) AS headings, len(regexp_extract_all(html, '(?i)<table(?:\\s|>)')) AS tables,
  len(regexp_extract_all(html, '(?i)<img(?:\\s|>)')) AS images,
  len(regexp_extract_all(html, '(?i)(?:src|href)\\s*=\\s*["''](?:https?:|file:|ftp:)')) AS external_links,
  trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), ' ') AS title
FROM h
""")
def html_profile(spark, t):
    extra = "\n \n<TABLE><tr><td><img src=\"http://x/a.png\"><a href = 'ftp://y'></table><h2>x</h2>"
    html = t.pages.select("page_id", F.concat("html", F.when(F.col("page_id") % 3 == 0, extra).otherwise("")).alias("html"),
                          F.lit("html-doc").alias("f"))
    return inspect.inspect_text(html, "html", "f").select(
        "page_id", "paragraphs", "headings", "tables", "images", "external_links", "title")


MARKED = [("markdown", "# a\n## b\n|x|y|\n|1|2|\n![i](p.png) [l](http://x)"),
          ("latex", "\\section{a}\\begin{table}\\begin{equation}\\includegraphics[w]{p}\\url{http://x}"),
          ("typst", "= a\n== b\n#image(\"p\") #table (x)"), ("txt", "# a")]


@query("i8_marked_text_profile", """
WITH d AS (SELECT doc_id, doc_id % 4 AS k, text || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN '.' ELSE '.' END AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(10) || chr(9)) <> '')) AS paragraphs,
  CASE k WHEN 0 THEN 2 + len(regexp_extract_all(text, '(?m)^#{1,6}\\s+.+$')) WHEN 1 THEN 1 WHEN 2 THEN 2 + len(regexp_extract_all(text, '(?m)^=+\\s+.+$')) END AS headings,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS tables,
  CASE k WHEN 0 THEN 1 + len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\([^)]+\\)')) WHEN 1 THEN 1 WHEN 2 THEN 1 END AS images,
  CASE k WHEN 1 THEN 1 END AS equations,
  CASE k WHEN 0 THEN 1 + len(regexp_extract_all(text, '\\]\\((?:https?:|file:|ftp:)[^)]+\\)')) WHEN 1 THEN 1 END AS external_links
FROM d
""")
def marked_profile(spark, t):
    k = (F.col("doc_id") % 4 + 1).cast("int")
    docs = t.documents.select(
        "doc_id", F.concat("text", F.lit("\n\n"), F.element_at(F.array(*[F.lit(x) for _, x in MARKED]), k)).alias("text"),
        F.element_at(F.array(*[F.lit(f) for f, _ in MARKED]), k).alias("f"))
    return inspect.inspect_text(docs, "text", "f").select(
        "doc_id", "paragraphs", "headings", "tables", "images", "equations", "external_links")


@query("i12_match_values", """
WITH m AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<(\\w+)[^>]*>', 1), lambda v: trim(v)), lambda v: v <> '') AS v FROM pages),
d AS (SELECT page_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m),
f AS (SELECT page_id, x, min(i) AS i FROM d GROUP BY page_id, x)
SELECT page_id, string_agg(x, ',' ORDER BY i) AS tags FROM f GROUP BY page_id
""")
def tag_names(spark, t):
    return t.pages.select("page_id", F.array_join(match_values(F.col("html"), r"<(\w+)[^>]*>"), ",").alias("tags"))


@query("i13_xml_value", """
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', '', 'g'), ' ' || chr(10)), '') AS title,
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), ' ' || chr(10)), '') AS h1,
  NULL AS missing FROM pages
""")
def xml_values(spark, t):
    html = F.col("html")
    return t.pages.select("page_id", xml_value(html, "title").alias("title"), xml_value(html, "h1").alias("h1"),
                          xml_value(html, "no-such").alias("missing"))


def image_files(t) -> DataFrame:
    """Image headers with sizes taken from the orders."""
    key = F.col("o_orderkey")
    w, h = (key * 37 % 9000 + 1), (key * 91 % 7000 + 1)

    def hx(n: Column, digits: int) -> Column:
        return F.lpad(F.hex(n), digits, "0")

    def swap(n: Column) -> Column:
        return F.regexp_replace(hx(n, 4), "(..)(..)", "$2$1")

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hx(w, 8), hx(h, 8), F.lit("08060000"))
    gif = F.concat(F.lit("474946383961"), swap(w), swap(h), F.lit("F70000"))
    jpeg = F.concat(F.lit("FFD8FFE00006AAAAAAAAFFC0001108"), hx(h, 4), hx(w, 4), F.lit("03012200021101031101FFD9"))
    k = key % 3
    return t.orders.select(
        key.alias("path"), F.when(k == 0, "png").when(k == 1, "gif").otherwise("jpeg").alias("format_id"),
        F.unhex(F.when(k == 0, png).when(k == 1, gif).otherwise(jpeg)).alias("content"))


@query("i14_i15_image_budget", """
WITH d AS (SELECT o_orderkey AS path, CAST(o_orderkey * 37 % 9000 + 1 AS BIGINT) AS width, CAST(o_orderkey * 91 % 7000 + 1 AS BIGINT) AS height FROM orders)
SELECT path, width, height, width * height AS decoded_pixels, CASE
  WHEN width * height > 40000000 THEN 'IMAGE_DIMENSIONS_UNSAFE: Decoded pixel count exceeds the budget.'
  WHEN width * height * 4 > 100000000 THEN 'IMAGE_MEMORY_UNSAFE: Estimated decoded image memory exceeds the budget.' END AS budget_error
FROM d
""")
def image_budgets(spark, t):
    sized = inspect.image_dimensions(image_files(t))
    return inspect.image_budget(sized, 40_000_000, 100_000_000).select(
        "path", "width", "height", "decoded_pixels", "budget_error")


# ---- archives and packages: one per document or part, made inside the tasks ----

@F.pandas_udf(T.BinaryType())
def zip_of(name: pd.Series, body: pd.Series) -> pd.Series:
    def pack(n: str, b: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/", b"")
            z.writestr(n, b.encode())
            z.writestr("note.txt", b"n" * 10)
        return out.getvalue()
    return pd.Series([pack(n, b) for n, b in zip(name, body)])


def zip_files(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("archive_id"), F.lit("zip").alias("format_id"), zip_of(
        F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")), F.col("text")).alias("content"))


@query("s10_archive_entries", """
SELECT doc_id AS archive_id, i AS idx, ['folder/', 'docs/' || lang || '/' || doc_id || '.txt', 'note.txt'][i + 1] AS path,
  [0, strlen(text), 10][i + 1] AS size, i = 0 AS directory FROM documents, (SELECT unnest([0, 1, 2]) AS i)
""")
def archive_entries(spark, t):
    return sources.scan_archive_entries(zip_files(t), "archive_id").select("archive_id", "idx", "path", "size", "directory")


@query("s11_extract", "SELECT doc_id AS archive_id, 'docs/' || lang || '/' || doc_id || '.txt' AS name, text FROM documents")
def extract(spark, t):
    wanted = t.documents.select(F.col("doc_id").alias("archive_id"), F.concat(
        F.lit("./docs\\"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"))
    out = sources.extract_archives(zip_files(t), wanted)
    return out.select("archive_id", "name", F.decode("content", "UTF-8").alias("text"))


@F.pandas_udf(T.BinaryType())
def office_of(kind: pd.Series, title: pd.Series, n: pd.Series) -> pd.Series:
    def docx(title: str, n: int) -> dict[str, str]:
        return {
            "word/document.xml": "<w:document>" + "<w:p><w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr></w:p>" + "<w:p >x</w:p>" * n
            + "<w:tbl><w:tr/></w:tbl><w:ins ><w:del>y</w:del></w:ins><w:sectPr/><w:sectPr></w:document>",
            "word/comments.xml": "<w:comment w:id='1'></w:comment>", "word/media/a.png": "x", "word/media/": "",
            "word/footnotes.xml": "<w:footnote >" * (n % 4), "word/vbaProject.bin": "v",
            "word/fontTable.xml": '<w:font w:name="Aptos"/><w:font w:name="Arial"/><w:font w:name="Aptos"/>',
            "docProps/core.xml": f"<dc:title>{title}</dc:title><dc:creator> <b>Ann</b> </dc:creator>",
            "word/_rels/document.xml.rels": "<Relationship TargetMode = 'External'/>" * (n % 3)}

    def pptx(title: str, n: int) -> dict[str, str]:
        out = {f"ppt/slides/slide{i + 1}.xml": "<a:p><a:p >" for i in range(n % 5)}
        return out | {"ppt/presentation.xml": "x", "ppt/charts/chart1.xml": "c", "docProps/core.xml": f"<dc:title>{title}</dc:title>"}

    def odt(title: str, n: int) -> dict[str, str]:
        return {"mimetype": "application/vnd.oasis.opendocument.text", "meta.xml": f"<dc:title>{title}</dc:title>",
                "content.xml": "<text:p>" * n + '<text:h ><table:table x><text:note a text:note-class="footnote">'
                "<x xlink:href='http://a'/>", "styles.xml": '<style:font-face style:name="Sans"/>'}

    def epub(title: str, n: int) -> dict[str, str]:
        return {"META-INF/container.xml": '<rootfile full-path="OEBPS/b.opf"/>', "OEBPS/a.opf": "<dc:title>no</dc:title>",
                "OEBPS/b.opf": f"<dc:title>{title}</dc:title>" + "<itemref idref='a'/>" * n, "c.JPG": "x"}

    makers = {"docx": docx, "pptx": pptx, "odt": odt, "epub": epub}

    def pack(kind: str, title: str, n: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in makers[kind](title, n).items():
                z.writestr(name, body)
        return out.getvalue()
    return pd.Series([pack(*row) for row in zip(kind, title, n)])


def office_files(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["docx", "pptx", "odt", "epub"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = spread(t.part.select("p_partkey", "p_name", "p_size"))
    return parts.select(F.col("p_partkey").alias("archive_id"), kind.alias("format_id"),
                        office_of(kind, F.col("p_name"), F.col("p_size")).alias("content"))


@query("i9_i10_package_profile", """
SELECT p_partkey AS archive_id, CASE k WHEN 0 THEN p_size + 1 WHEN 1 THEN 2 * (p_size % 5) WHEN 2 THEN p_size END AS paragraphs,
  CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 END AS headings, CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 END AS tables,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS images, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS comments,
  CASE k WHEN 0 THEN 2 WHEN 2 THEN 0 END AS tracked_changes, CASE k WHEN 0 THEN greatest(p_size % 4 - 2, 0) WHEN 2 THEN 1 END AS footnotes,
  CASE k WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN p_size END AS sections, CASE k WHEN 1 THEN p_size % 5 END AS slides, CASE k WHEN 1 THEN 1 END AS charts,
  k = 0 AS macros, CASE k WHEN 0 THEN p_size % 3 WHEN 2 THEN 1 ELSE 0 END AS external_links,
  CASE k WHEN 0 THEN 'Aptos,Arial' WHEN 2 THEN 'Sans' ELSE '' END AS fonts, p_name AS title, CASE k WHEN 0 THEN 'Ann' END AS author
FROM (SELECT *, p_partkey % 4 AS k FROM part)
""")
def package_profile(spark, t):
    files = office_files(t)
    members = sources.package_members(files, packages.MEMBERS)
    return packages.inspect_packages(members, files).select(
        "archive_id", "paragraphs", "headings", "tables", "images", "comments", "tracked_changes", "footnotes", "sections",
        "slides", "charts", "macros", "external_links", F.array_join("fonts", ",").alias("fonts"), "title", "author")


@query("i11_external_relationships", """
SELECT p_partkey AS archive_id, p_size % 3 AS external_links FROM part WHERE p_partkey % 4 = 0
""")
def relationships(spark, t):
    members = sources.package_members(office_files(t).where("format_id = 'docx'"), packages.MEMBERS)
    return packages.external_relationships(members)


# ---- validation ----

@query("v2_validate_json", """
SELECT event_id AS doc_id, event_id % 6 NOT IN (2, 4, 5) AS valid, CASE WHEN event_id % 6 NOT IN (2, 4, 5) THEN CASE event_id % 6 WHEN 1 THEN 3 ELSE 1 END END AS rows,
  CASE WHEN event_id % 6 NOT IN (2, 4, 5) THEN CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 2 END END AS columns FROM events
""")
def json_check(spark, t):
    k = F.col("event_id") % 6
    text = (F.when(k == 0, F.col("props"))
            .when(k == 1, F.concat(F.lit("["), F.col("props"), F.lit(', {"a": [1, {"b": 2}]}, 42]')))
            .when(k == 2, F.concat(F.col("props"), F.lit(" x"))).when(k == 3, F.lit("7"))
            .when(k == 4, F.lit("[{broken")).otherwise(F.lit("")))
    docs = t.events.select(F.col("event_id").alias("doc_id"), text.alias("text"))
    return validate.validate_json(docs, lines=False).select("doc_id", "valid", "rows", "columns")


@query("v2_validate_json_lines", """
SELECT user_id AS doc_id, user_id % 5 <> 0 AS valid, CASE WHEN user_id % 5 <> 0 THEN count(*) END AS rows,
  CASE WHEN user_id % 5 <> 0 THEN 1 END AS columns FROM events GROUP BY user_id
""")
def jsonl_check(spark, t):
    docs = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(F.concat(
        F.array_join(F.collect_list("props"), "\r\n \n"), F.when(F.first("user_id") % 5 == 0, "\n{oops").otherwise("\n")).alias("text"))
    return validate.validate_json(docs, lines=True).select("doc_id", "valid", "rows", "columns")


@query("v3_validate_subtitles", f"""
WITH {CUES_SQL} SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS valid, CASE doc_id % 4
  WHEN 1 THEN 'SUBTITLE_PARSE_FAILED: No SRT cues were found.' WHEN 2 THEN 'SUBTITLE_TIME_INVALID: 0:0:0:0' END AS error
FROM norm GROUP BY doc_id
""")
def subtitle_check(spark, t):
    docs = serialize_srt(spark, t)
    k = F.col("doc_id") % 4
    damaged = F.when(k == 1, F.replace("text", F.lit("-->"), F.lit("->"))).when(
        k == 2, F.concat("text", F.lit("\n9\n0:0:0:0 --> 1:2\nx\n"))).otherwise(F.col("text"))
    return validate.validate_text(docs.withColumn("text", damaged), "srt").select(
        "doc_id", "valid", F.trim("error").alias("error"))


@query("v3_validate_meshes", f"""
WITH {MESH_SQL} SELECT mesh_id AS doc_id, mesh_id % 3 <> 0 AS valid,
  CASE WHEN mesh_id % 3 = 0 THEN 'MESH_FACE_INVALID: Face index is out of range.' END AS error FROM big
""")
def mesh_check(spark, t):
    docs = obj_text(t).withColumn("text", F.when(F.col("mesh_id") % 3 == 0, F.concat("text", F.lit("f 1 2 999999\n")))
                                  .otherwise(F.col("text"))).withColumnRenamed("mesh_id", "doc_id")
    return validate.validate_text(docs, "obj").select("doc_id", "valid", "error")


@query("v4_validation_report", """
WITH x AS (SELECT page_id % 16 AS k, ['png', 'wav', 'mp3', 'flac', 'zip', 'html-doc'][page_id % 6 + 1] AS declared,
  ['html-doc', 'json-data', 'jsonl', 'srt', 'vtt', 'png', 'zip', 'gzip', 'wav', 'mp3', 'aac', 'rtf', NULL, 'mpegts', 'latex', 'tiff'][page_id % 16 + 1] AS body FROM pages),
y AS (SELECT CASE declared WHEN 'png' THEN 'image' WHEN 'zip' THEN 'archive' WHEN 'html-doc' THEN 'document' ELSE 'audio' END AS category,
  coalesce(body, declared) = declared AND declared <> 'flac' AND (declared <> 'wav' OR body IS NOT NULL)
    AND (declared <> 'mp3' OR body IS NOT NULL) AS valid FROM x)
SELECT category, valid, count(*) AS files FROM y GROUP BY category, valid
""")
def report(spark, t):
    from tablemill.operators.formats import audit_labels
    from tablemill.plans.corpus import LABELS, _pick, catalogue

    claimed = catalogue(t).withColumn("declared", _pick(LABELS, F.col("page_id") % 6))
    return validate.validation_report(audit_labels(claimed)).select("category", "valid", "files")
