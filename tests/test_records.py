import random
import struct

import pytest
from pyspark.sql import functions as F

from tablemill.operators import mesh, pages, science, subtitles
from tablemill.plans.run import run_corpus
from tablemill.streaming.ingest import ingest_available


def cues(df):
    return [(r["start_ms"], r["end_ms"], r["text"]) for r in df.orderBy("doc_id", "pos").collect()]


def docs(frame, *texts):
    return frame(list(enumerate(texts)), "doc_id int, text string")


def test_srt(frame):
    text = "\ufeff1\r\n00:00:01,250 --> 00:00:03,500\r\nHello\r\nworld\r\n\r\n00:05.0 --> 1:00:06\n tail \n\nno cue\n"
    srt = docs(frame, text)
    assert cues(subtitles.parse_srt(srt)) == [(1250, 3500, "Hello\nworld"), (5000, 3606000, "tail")]
    vtt = subtitles.translate_subtitles(srt, "srt", "vtt")
    assert cues(subtitles.parse_vtt(vtt)) == cues(subtitles.parse_srt(srt))


def test_ass(frame):
    text = ("[Script Info]\nDialogue: 0,0:00:09.00,0:00:10.00,x,,0,0,0,,no\n[Events]\nFormat: Start, End, Style, Text\n"
            "Dialogue: 0:00:01.00,0:00:02.50,Default,{\\b1}Hello{\\b0}\\Nworld, and more\n[Fonts]\nDialogue: 0:00:09.00,0:00:10.00,x,no\n")
    assert cues(subtitles.parse_ass(docs(frame, text))) == [(1000, 2500, "Hello\nworld, and more")]


def test_broken_subtitles_are_isolated(frame):
    bad = docs(frame, "1\n00:00:01,000 --> 00:00:02,000\nok", "nothing", "1\n0:0:0:1 --> 00:02\nx")
    out = {r["doc_id"]: r for r in subtitles.translate_subtitles(bad, "srt", "ass").collect()}
    assert out[0]["error"] is None and out[0]["text"].endswith("Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,ok\n")
    assert "SUBTITLE_PARSE_FAILED" in out[1]["error"] and "SUBTITLE_TIME_INVALID" in out[2]["error"]


def test_parts_put_together_are_the_whole_file(frame):
    rows = frame([(7, i, i * 1000, i * 1000 + 500, f"c{i}") for i in range(25)], "doc_id int, pos bigint, start_ms bigint, end_ms bigint, text string")
    for fmt in ("srt", "vtt", "ass"):
        whole = subtitles.serialize_cues(rows, fmt).first()["text"]
        parts = subtitles.serialize_cues(rows, fmt, rows=4).orderBy("part").collect()
        assert len(parts) == 7 and "".join(p["text"] for p in parts) == whole


OBJ = "# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\nv 1 1 0.5\nf -4/1/1 -3//2 -1 -2\n"


def test_obj_and_round_trips(frame):
    data = frame([(1, OBJ), (2, "v 0 0 x\nv 1 1 1\nf 1 2 9\n"), (3, "v 0 0 0\n")], "mesh_id int, text string")
    vertices, triangles = mesh.parse_obj(data)
    one = triangles.where("mesh_id = 1").orderBy("idx").select("a", "b", "c").collect()
    assert [tuple(r) for r in one] == [(0, 1, 2), (0, 1, 3), (0, 3, 2)]
    report = {r["mesh_id"]: r["error"] for r in mesh.mesh_guard(vertices, triangles).collect()}
    assert report[1] is None and "COORDINATE" in report[2] and "PARSE_FAILED" in report[3]
    assert {r["mesh_id"]: r["error"] for r in mesh.mesh_report(data, "obj").collect()} == report
    good = [d.where("mesh_id = 1") for d in (vertices, triangles)]
    for fmt, parse in (("obj", mesh.parse_obj), ("ply", mesh.parse_ply)):
        for rows in (10_000, 1):
            parts = mesh.serialize_mesh(*good, fmt, rows=rows).orderBy("section", "part").collect()
            text = "".join(p["text"] for p in parts)
            again = parse(frame([(1, text)], "mesh_id int, text string"))
            for before, after in zip(good, again):
                assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_stl(frame):
    ascii_stl = b"solid x\nfacet\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 -2.5e-1\nendfacet"
    binary = b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12f", *range(12)) + b"\0\0"
    vertices, triangles = mesh.parse_stl(frame([(1, bytearray(ascii_stl)), (2, bytearray(binary))], "mesh_id int, content binary"))
    got = {k: [(r["x"], r["y"], r["z"]) for r in vertices.where(F.col("mesh_id") == k).orderBy("idx").collect()] for k in (1, 2)}
    assert got[1][2] == (0.0, 1.0, -0.25) and got[2] == [(3.0, 4.0, 5.0), (6.0, 7.0, 8.0), (9.0, 10.0, 11.0)]
    assert triangles.count() == 2
    parts = mesh.serialize_mesh(vertices.where("mesh_id = 2"), triangles.where("mesh_id = 2"), "stl").orderBy("section", "part").collect()
    data = b"".join(bytes(p["content"]) for p in parts)
    assert len(data) == 134 and data[80:84] == b"\x01\0\0\0" and data[96:132] == binary[96:132]


def test_torn_stl_is_refused(frame):
    torn = b"solid x\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nvertex 2 2 2"
    vertices, triangles = mesh.parse_stl(frame([(1, bytearray(torn))], "mesh_id int, content binary"))
    assert mesh.mesh_guard(vertices, triangles).first()["error"].startswith("MESH_FACE_INVALID")


def test_ply_header_errors(frame):
    head = "ply\nformat {}\nelement vertex 1\nproperty float x\nproperty float y\nproperty float {}\nelement face {}\nend_header\n0 0 0\n3 0 0 0\n"
    data = frame([(1, head.format("ascii 1.0", "z", 1)), (2, head.format("binary_little_endian 1.0", "z", 1)), (3, head.format("ascii 1.0", "w", 1)),
                  (4, head.format("ascii 1.0", "z", 5)), (5, "ply\n")], "mesh_id int, text string")
    found = {r["mesh_id"]: r["error"] or "" for r in mesh.ply_headers(data).collect()}
    assert found[1] == "" and "PLY_BINARY" in found[2] and "x/y/z" in found[3] and "truncated" in found[4] and "incomplete" in found[5]


def test_fits(frame):
    def card(text):
        return text.ljust(80)
    header = card("SIMPLE  =                    T") + card("BITPIX  =                   16 / bits / pixel") + card("NAME    = 'a/b''c' / quoted") \
        + card("") + card("COMMENT free text") + card("END")
    data = frame([("ok", bytearray(header.encode())), ("open", bytearray(card("SIMPLE  = T").encode())), ("small", bytearray(b"x"))],
                 "path string, content binary")
    got = [(r["keyword"], r["value"], r["comment"]) for r in science.fits_cards(data).orderBy("idx").collect()]
    assert got == [("SIMPLE", "T", None), ("BITPIX", "16", "bits / pixel"), ("NAME", "'a/b''c'", "quoted"), ("COMMENT", "free text", None)]
    errors = {r["path"]: r["error"] for r in science.fits_headers(data).collect()}
    assert errors["ok"] is None and "END card" in errors["open"] and "too small" in errors["small"]


def test_embedded_previews(frame):
    short, long = b"\xff\xd8\xff" + b"\1\2" + b"\xff\xd9", b"\xff\xd8\xff" + b"\1" * 6 + b"\xff\xd9"
    data = frame([(1, bytearray(b"\0\0" + short + b"\0" + long + b"\0")), (2, bytearray(b"\xff\xd8\xff\1")), (3, bytearray(short + short))],
                 "path int, content binary")
    found = {r["path"]: (r["offset"], r["length"], r["error"]) for r in science.largest_embedded_jpeg(data, 5).collect()}
    assert found[1] == (10, 11, None) and found[2][0] is None and found[2][2] and found[3][:2] == (0, 7)
    assert bytes(science.extract_previews(data, 5).where("path = 1").first()["content"]) == long


def test_books(frame):
    book = ("<FictionBook><book-title>T &lt; 1</book-title><author><first-name>A</first-name><last-name>B</last-name></author><body><section>"
            "<title><p>One</p></title><p>x &amp; <b>y</b></p><subtitle>s</subtitle><empty-line/></section></body></FictionBook>")
    blocks = science.fb2_blocks(frame([(1, bytearray(book.encode())), (2, bytearray(b"<x>")), (3, bytearray(b"<a><p>only</p></a>"))], "path int, content binary"))
    text = "".join(r["text"] for r in science.fb2_html(blocks).where("path = 1").orderBy("section", "part").collect())
    assert "<h1>T &lt; 1</h1><p>A B</p><h2>One</h2>\n<p>x &amp; y</p>\n<h3>s</h3>\n<br></body>" in text
    assert blocks.where("path = 2").first()["error"].startswith("FB2_XML_INVALID")
    assert [r["kind"] for r in blocks.where("path = 3").orderBy("pos").collect()] == ["h1", "p"]


def test_greedy_anchor_lines(frame):
    runs = [("d", 1, 0, 50.0, 10.0, "right"), ("d", 1, 1, 0.0, 8.5, "left"), ("d", 1, 2, 10.0, 7.0, "low"), ("d", 1, 3, 0.0, 100.0, "top"),
            ("d", 1, 4, 5.0, 100.0, ""), ("d", 2, 0, 0.0, 1.0, "  a \t b ")]
    out = pages.reconstruct_lines(frame(runs, "doc string, page int, seq int, x double, y double, str string"), chunk=1)
    got = [(r["page"], r["text"]) for r in out.orderBy("page", "band", "line").collect()]
    # "left" comes before "right" and is the anchor; "low" is sorted below "right" by its height
    assert got == [(1, "top"), (1, "left right low"), (2, "a b")]


def test_page_specs(frame):
    specs = [("1-3,5,9-7", 10), ("all", 2), ("4-x", 9), ("3-12", 9), ("2;5-4", 9)]
    out = pages.expand_page_specs(frame([(i, s, m) for i, (s, m) in enumerate(specs)], "i int, s string, m int"), "s", "m").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["i"], r["part"], r["pos"] or 0)):
        by.setdefault((r["i"], r["part"]), []).append(r["page"] if r["error"] is None else r["error"])
    assert by[0, 1] == [1, 2, 3, 5, 9, 8, 7] and by[1, 1] == [1, 2] and "4-x" in by[2, 1][0] and "Page 10 is outside 1-9" in by[3, 1][0]
    assert by[4, 1] == [2] and by[4, 2] == [5, 4]


def test_corpus_conversion_isolates_failures(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (inbox / "b.csv").write_text("x,y\n5,6\n")
    (inbox / "A.jsonl").write_text('{"a":1}\n42\n')
    (inbox / "bad.jsonl").write_text('{"a":1}\n{broken\n')
    (inbox / "what.bin").write_bytes(b"\1\2\3")
    (inbox / "fake.parquet").write_bytes(b"PAR1junk")
    done = {r["source_name"]: r for r in run_corpus(spark, str(inbox), "csv", str(tmp_path / "out"), {"template": "{name}"}).collect()}
    assert len(done) == 6 and len({r["output_name"].lower() for r in done.values() if r["output_name"]}) == 3
    assert (done["a.csv"]["state"], done["a.csv"]["rows"]) == ("completed", 2)
    assert done["what.bin"]["stage"] == "Cannot plan" and done["bad.jsonl"]["stage"] == "Failed" and done["fake.parquet"]["state"] == "failed"
    name = done["A.jsonl"]["output_name"]
    text = "".join(p.read_text() for p in (tmp_path / "out" / f"output_name={name}").glob("part-*"))
    assert text == "a,value,row_index\n1,,\n,42,1\n"


def test_corpus_names_with_blanks_and_accents(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("c d.csv", "é+%20.csv", "q r.jsonl"):
        (inbox / name).write_text('{"x":1}\n{"x":2}\n' if name.endswith("jsonl") else 'x,y\n1,"a\nb"\n2,c\n')
    done = {r["source_name"]: r for r in run_corpus(spark, str(inbox), "csv", str(tmp_path / "out"), {"template": "{name}"}).collect()}
    assert {n: (r["state"], r["rows"]) for n, r in done.items()} == dict.fromkeys(("c d.csv", "é+%20.csv", "q r.jsonl"), ("completed", 2))


def test_corpus_query_runs_per_file(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("x\n1\n3\n")
    (inbox / "b.csv").write_text("x\n5\n")
    done = run_corpus(spark, str(inbox), "csv", str(tmp_path / "out"), {"query": "SELECT sum(x) AS s FROM data"})
    assert {r["source_name"]: r["rows"] for r in done.collect()} == {"a.csv": 1, "b.csv": 1}
    sums = [p.read_text() for p in sorted((tmp_path / "out").glob("*/part-*"))]
    assert sums == ["s\n4\n", "s\n5\n"]


def test_intake_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    where = [str(tmp_path / n) for n in ("in", "cat", "progress")]
    (inbox / "a.json").write_text("{}")
    ingest_available(spark, *where).awaitTermination()
    (inbox / "b.vtt").write_text("WEBVTT\n")
    ingest_available(spark, *where).awaitTermination()
    ingest_available(spark, *where).awaitTermination()
    assert sorted((r["name"], r["format_id"]) for r in spark.read.parquet(where[1]).collect()) == [("a.json", "json-data"), ("b.vtt", "vtt")]


def test_mesh_arrays_are_computed_once(frame):
    """The filter inferred for an explode must not parse the document again."""
    docs = frame([(1, "v 1 2 3\nv 4 5 6\nv 7 8 9\nf 1 2 3\n")], "mesh_id bigint, text string")
    for parse in (mesh.parse_obj, mesh.parse_ply):
        for table in parse(docs):
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
            assert not any("transform(" in line for line in filters), plan


def test_js_trim_is_the_pattern_it_stands_for(frame):
    from tablemill.functions.text import JS_SPACE, js_trim

    blanks = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c in (0, 0x85, 0x180E, 0x200B, 0xFEFF))]
    values = [None, "", " ", "a", "\r\n a b \u0085", "a \n\u0085\n"] + [t for b in blanks for t in (b, b + "a", "a" + b, f" {b} a{b}b {b} ")]
    rows = frame([(v,) for v in values], "v string")
    old = F.regexp_replace("v", f"^{JS_SPACE}+|{JS_SPACE}+$", "")
    wrong = rows.where(~js_trim(F.col("v")).eqNullSafe(old)).collect()
    assert not wrong


def test_level_and_rough_bands_across_batches(spark, frame):
    """Bands within the tolerance are one line each, from left to right, also where a batch ends inside of one."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        level = [(1, 1, 10 * n + k, float(-k), 100.0 - 10 * n + k % 2, f"w{n}\u00a0 {k}") for n in range(5) for k in range(4)]
        rough = [(1, 2, 0, 0.0, 50.0, "a"), (1, 2, 1, 1.0, 48.5, "b"), (1, 2, 2, 0.0, 47.0, "c"), (2, 1, 0, float("nan"), 1.0, "z"),
                 (2, 1, 1, 5.0, 1.0, "y"), (2, 1, 2, 5.0, 1.0, "x")]
        rows = pages.reconstruct_lines(frame(level + rough, "doc int, page int, seq int, x double, y double, str string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    got = sorted((r["doc"], r["page"], r["band"], r["line"], r["y"], r["text"]) for r in rows)
    assert got == [(1, 1, n, 0, 101.0 - 10 * n, f"w{n} 3 w{n} 2 w{n} 1 w{n} 0") for n in range(5)] + [
        (1, 2, 0, 0, 50.0, "a b"), (1, 2, 0, 1, 47.0, "c"), (2, 1, 0, 0, 1.0, "y x z")]


def test_pages_are_shuffled_once(spark, frame):
    """Runs of ordinary pages are not shuffled for their heights and again for their bands, but packed, and once."""
    runs = [(d, p, 7919 * i % 1003, float(i % 8), 800.0 - i // 8 * 12 + i % 2 * 0.75, f"w{i}") for d in (1, 2) for p in (0, 1) for i in range(200)]
    out = pages.reconstruct_lines(frame(runs, "doc int, page int, seq int, x double, y double, str string"))
    got = sorted((r["doc"], r["page"], r["band"], r["text"]) for r in out.collect())
    assert got == [(d, p, n, " ".join(f"w{8 * n + k}" for k in range(8))) for d in (1, 2) for p in (0, 1) for n in range(25)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("== Initial Plan ==")]
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in plan, plan


@pytest.mark.parametrize("seq", ["int", "string"])
def test_packed_pages_hold_what_large_ones_do(spark, frame, seq):
    """Missing keys, heights, places and numbers, split packs and pages of both kinds give the lines of large pages."""
    rng = random.Random(7)
    heights = [0.0, -0.0, 1.0, 2.0, 3.9, 10.5, float("nan"), float("inf"), float("-inf"), None, 98.0, 96.1]
    runs = []
    for d in (1, 2, None):
        for p in (1, 2, None):
            for k in range(rng.choice([1, 30, 90])):
                number = len(runs) * 7919 % 100_003
                runs.append((d, p, None if k == 0 else str(number) if seq == "string" else number, rng.choice([0.0, 1.5, None, float("nan")]),
                             rng.choice(heights), rng.choice(["a", "b ü", " c ", "", None, "d" * 70_000])))
    rng.shuffle(runs)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = frame(runs, f"doc int, page int, seq {seq}, x double, y double, str string")
        got = [sorted(str(tuple(r)) for r in pages.reconstruct_lines(df, chunk=chunk).collect()) for chunk in (1, 30, 20_000)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got[0] and got[0] == got[1] == got[2]
