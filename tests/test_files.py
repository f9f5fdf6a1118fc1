import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tablemill.functions.text import ustar_split
from tablemill.operators import archive, batch, formats, inspect, naming, packages, routes
from tablemill.sinks import writers
from tablemill.sources import files as sources

DETECTION = [
    ("x.parquet", b"PAR1....", "parquet"), ("x.arrow", b"ARROW1..", "arrow"), ("x.db", b"SQLite format 3\0", "sqlite"),
    ("a.json", b'{"name":"Jonathan"}', "json-data"), ("a.jsonl", b'{"a":1}\n{"a":2}', "jsonl"), ("a.jsonl", b'{"a":1}', "jsonl"),
    ("a.rtf", b"{\\rtf1 hello", "rtf"), ("a.html", b"<!doctype html><p>", "html-doc"), ("a.tex", b"\\documentclass{article}", "latex"),
    ("a.mp4", b"\0\0\0\x18ftypisom\0\0\0\0isom", "mp4"), ("a.mov", b"\0\0\0\x18ftypqt  \0\0\0\0qt  ", "mov"),
    ("a.avif", b"\0\0\0\x18ftypavif\0\0\0\0mif1", "avif"), ("a.heic", b"\0\0\0\x18ftypmif1\0\0\0\0heic", "heic"),
    ("a.flac", b"fLaC\0", "flac"), ("a.mp3", b"ID3\x04", "mp3"), ("a.aac", b"\xff\xf1\x50", "aac"),
    ("a.psd", b"8BPS\0\x01", "psd"), ("a.psb", b"8BPS\0\x02", "psb"), ("a.vtt", b"WEBVTT\n", "vtt"),
    ("a.ply", b"ply\nformat ascii 1.0\n", "ply"), ("a.fits", b"SIMPLE  =   T", "fits"),
    ("a.nef", b"II*\0", "camera-raw"), ("a.tiff", b"II*\0", "tiff"), ("a.cr2", b"II*\0\x10\0\0\0CR\x02\0", "camera-raw"),
    ("a.raf", b"FUJIFILMCCD-RAW 0201", "camera-raw"), ("a.zip", b"PK\x03\x04", "zip"), ("a.7z", b"7z\xbc\xaf\x27\x1c", "7z"),
    ("a.rar", b"Rar!\x1a\x07\0", "rar"), ("a.gz", b"\x1f\x8b", "gzip"), ("a.bz2", b"BZh9", "bzip2"), ("a.xz", b"\xfd7zXZ\0", "xz"),
    ("a.zst", b"\x28\xb5\x2f\xfd", "zstd"), ("a.tar", b"\0" * 257 + b"ustar\0", "tar"), ("backup.tar.gz", b"\x1f\x8b", "tar-gzip"),
    ("semi.csv", b"a;b\n1;2", "csv"), ("x", b"Go", "mpegts"), ("x.unknown", b"zzz", None), ("a.webm", b"\x1a\x45\xdf\xa3..webm", "webm-media"),
    ("a.mkv", b"\x1a\x45\xdf\xa3..matroska", "mkv"), ("a.svg", b"<?xml version='1'?>\n<!-- c -->\n<svg ", "svg"), ("a.obj", b"v 1 2 3\nf 1 2 3", "obj"),
    ("a.gltf", b"{}", "gltf"), ("a.fb2", b"<?xml?><FictionBook xmlns='x'>", "fb2"), ("a.dxf", b"0\nSECTION\n", "dxf"),
    ("a.ass", b"[Script Info]\n[Events]\n", "json-data"), ("b.ass", b"; c\n[Script Info]\n[Events]\n", "ass"), ("a.bin", b"\x80\xfe\xfa\x80", None), ("b.bin", b"\xff\xfe\xfa\x80", "mp3"),
]


def test_detection_table(frame):
    data = frame([(i, n, "", bytearray(b)) for i, (n, b, _) in enumerate(DETECTION)], "i int, name string, mime string, content binary")
    found = {r["i"]: r["format_id"] for r in formats.compound_suffix(formats.detect_formats(data)).collect()}
    wrong = [(DETECTION[i], found[i]) for i in found if found[i] != DETECTION[i][2]]
    assert not wrong


def test_confidence_and_warnings(frame):
    data = frame([("a.png", "", bytearray(b"PK\x03\x04")), ("a.xyz", "", bytearray(b"zzz")), ("a.csv", "", bytearray(b"zzz")),
                  ("a.csv", "text/plain", bytearray(b"zzz"))], "name string, mime string, content binary")
    got = [(r["format_id"], r["confidence"], len(r["warnings"])) for r in formats.detect_formats(data).collect()]
    assert got == [("zip", 0.99, 1), (None, 0.75, 0), ("csv", 0.62, 0), ("csv", 0.62, 0)]


def test_registry(spark):
    table = formats.format_registry(spark)
    assert table.count() == 86 and table.select("format_id").distinct().count() == 86


def test_mislabelled_audio(frame):
    wave = bytearray(b"RIFF\0\0\0\0WAVE")
    found = formats.audit_labels(frame([("flac", wave), ("wav", wave)], "declared string, content binary")).collect()
    assert [r["valid"] for r in found] == [False, True]
    assert any("magic bytes" in e for e in found[0]["errors"])


PATHS = [("./folder\\file.txt", "folder/file.txt", None), ("../evil.txt", None, "Parent"), ("/etc/passwd", None, "Absolute"),
         ("C:\\Windows\\file.txt", None, "Absolute"), ("safe/../../evil", None, "Parent"), ("a\0b", None, "NUL"), ("./", None, "Empty"),
         ("x/" * 2100, None, "too long"), ("a//./b/", "a/b", None)]


def test_paths(frame):
    found = archive.normalize_paths(frame([(i, p) for i, (p, _, _) in enumerate(PATHS)], "i int, path string")).orderBy("i").collect()
    for row, (_, path, reason) in zip(found, PATHS):
        assert row["path"] == path and (row["path_error"] is None) == (reason is None)
        assert reason is None or reason in row["path_error"]


def test_bomb_duplicates_and_collisions(frame):
    entries = frame([(1, 0, "x.bin", 128 << 20), (2, 0, "Folder/a.txt", 1), (2, 1, "Folder/a.txt", 1), (2, 2, "folder/A.txt", 1),
                     (3, 0, "ok", 1), (3, 1, "../x", 1), (4, 0, "a", -5)], "archive_id int, idx bigint, path string, size bigint")
    files = frame([(1, 65_536), (2, 1000), (3, 1000), (4, 0), (5, 0)], "archive_id int, source_bytes bigint")
    found = {r["archive_id"]: r for r in archive.assess_archives(entries, files).collect()}
    assert found[1]["error"].startswith("ARCHIVE_BOMB_SUSPECTED")
    assert (found[2]["duplicates"], found[2]["case_collisions"], found[2]["safe"]) == (1, 1, True)
    assert found[3]["error"].startswith("ARCHIVE_PATH_UNSAFE")
    assert (found[4]["ratio"], found[5]["ratio"], found[5]["entries"]) == (1.0, 1.0, 0)
    assert archive.assess_archives(entries, files, {"max_entries": 2}).where("archive_id = 2").first()["error"].startswith(
        "ARCHIVE_ENTRY_LIMIT")


def tar_bytes(*entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind, body in entries:
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, len(body), "target" if kind == tarfile.SYMTYPE else ""
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archive_listing_and_extraction(frame):
    tar = tar_bytes(("d", tarfile.DIRTYPE, b""), ("d/a.txt", tarfile.REGTYPE, b"one"), ("d/a.txt", tarfile.REGTYPE, b"two"),
                    ("link", tarfile.SYMTYPE, b""), ("../evil", tarfile.REGTYPE, b"x"))
    import bz2
    import gzip
    import lzma

    files = frame([
        ("t", "t.tar", "tar", bytearray(tar)), ("g", "g.tar.gz", "tar-gzip", bytearray(gzip.compress(tar))),
        ("b", "b.tar.bz2", "tar-bzip2", bytearray(bz2.compress(tar))), ("x", "x.tar.xz", "tar-xz", bytearray(lzma.compress(tar))),
        ("s", "hello.txt.gz", "gzip", bytearray(gzip.compress(b"hello"))), ("bad", "bad.zip", "zip", bytearray(b"PK\x03\x04junk"))],
        "archive_id string, name string, format_id string, content binary")
    listed = sources.scan_archive_entries(files, "archive_id")
    assert [(r["path"], r["type"], r["size"]) for r in listed.where("archive_id = 'g'").orderBy("idx").collect()] == [
        ("d", "directory", 0), ("d/a.txt", "file", 3), ("d/a.txt", "file", 3), ("link", "symlink", 0), ("../evil", "file", 1)]
    assert listed.where("archive_id = 's'").first()["path"] == "hello.txt"
    assert "ARCHIVE_CORRUPT" in listed.where("archive_id = 'bad'").first()["error"]
    got = {(r["archive_id"], r["name"]): r["content"] for r in sources.extract_archives(files).collect()}
    assert bytes(got["x", "d/a.txt"]) == b"one" and bytes(got["x", "d/a.txt.2"]) == b"two" and got["x", None] is None
    chosen = frame([("t", "./d\\a.txt")], "archive_id string, path string")
    assert sources.extract_archives(files, chosen).count() == 2


def test_archive_shards(spark, frame, tmp_path):
    data = frame([(0, "a/x.txt", bytearray(b"hello world 14")), (1, "A/X.txt", bytearray(b"b")), (2, "c\\d.txt", bytearray(b""))],
                 "idx bigint, path string, content binary")
    writers.write_archive_shards(data.limit(1), str(tmp_path / "tar"), "tar", shards=1)
    tar = next((tmp_path / "tar").glob("*.tar"))
    assert tar.stat().st_size == 2048 and tarfile.open(tar).getnames() == ["a/x.txt"]
    writers.write_archive_shards(data, str(tmp_path / "zip"), "zip", 9, shards=1)
    names = zipfile.ZipFile(next((tmp_path / "zip").glob("*.zip"))).namelist()
    assert sorted(names) == ["A/X (2).txt", "a/x.txt", "c/d.txt"]
    writers.write_archive_shards(data, str(tmp_path / "flat"), "zip", 0, preserve_paths=False, shards=1)
    assert sorted(zipfile.ZipFile(next((tmp_path / "flat").glob("*.zip"))).namelist()) == ["X (2).txt", "d.txt", "x.txt"]
    with pytest.raises(Exception, match="ARCHIVE_PATH_UNSAFE"):
        writers.write_archive_shards(frame([(0, "../x", bytearray(b"x"))], "idx bigint, path string, content binary"), str(tmp_path / "bad"))


def test_ustar_names(frame):
    long = "folder/" * 20 + "file.txt"
    name, prefix, error = frame([(long,)], "p string").select(ustar_split(F.col("p")).alias("s")).first()["s"]
    assert error is None and prefix and f"{prefix}/{name}" == long
    assert "TAR_PATH_TOO_LONG" in frame([("x" * 260,)], "p string").select(ustar_split(F.col("p")).alias("s")).first()["s"]["error"]


def test_docx_profile(frame):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pStyle w:val="Heading1"/></w:p><w:tbl></w:tbl><w:ins ></w:ins>')
        z.writestr("word/comments.xml", "<w:comment ></w:comment>")
        z.writestr("word/media/i.png", b"x")
        z.writestr("word/_rels/document.xml.rels", '<R TargetMode="External"/>')
        z.writestr("word/vbaProject.bin", b"v")
        z.writestr("word/fontTable.xml", '<w:font w:name="Aptos"/>')
    files = frame([("d", "docm", bytearray(out.getvalue())), ("o", "doc", bytearray(b"\xd0\xcf")), ("e", "docx", bytearray(b"PK\x03\x04"))],
                  "archive_id string, format_id string, content binary")
    members = sources.package_members(files.where("archive_id <> 'o'"), packages.MEMBERS)
    found = {r["archive_id"]: r for r in packages.inspect_packages(members, files).collect()}
    doc = found["d"]
    assert [doc[c] for c in ("headings", "tables", "comments", "images", "tracked_changes", "external_links")] == [1, 1, 1, 1, 1, 1]
    assert doc["macros"] and doc["fonts"] == ["Aptos"] and len(doc["warnings"]) == 2
    assert found["o"]["macros"] and found["o"]["paragraphs"] is None
    kinds = formats.sniff_packages(members).collect()
    assert {r["archive_id"]: r["package_id"] for r in kinds}["d"] == "docm"


def test_image_headers(frame):
    png = bytearray(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (4000).to_bytes(4, "big") + (3000).to_bytes(4, "big") + b"\x08")
    gif = bytearray(b"GIF89a" + (320).to_bytes(2, "little") + (240).to_bytes(2, "little"))
    sized = inspect.image_dimensions(frame([(1, "png", png), (2, "gif", gif), (3, "png", png[:20]), (4, "jpeg", bytearray(b"\xff\xd8\xff"))],
                                           "i int, format_id string, content binary"))
    assert [(r["width"], r["height"]) for r in sized.orderBy("i").collect()] == [(4000, 3000), (320, 240), (None, None), (None, None)]
    flagged = inspect.image_budget(sized, 10_000_000, 10**9).orderBy("i").collect()
    assert flagged[0]["budget_error"].startswith("IMAGE_DIMENSIONS_UNSAFE") and flagged[1]["budget_error"] is None


def one_name(frame, template, source, ext, fmt, idx=0):
    df = frame([(source, idx, 9)], "source_name string, idx bigint, total bigint")
    return naming.render_names(df, template, ext, fmt, "2024-05-06").first()["output_name"]


def test_names(frame):
    assert one_name(frame, "{index:03}-{name}-{format}", "holiday.photo.jpg", "webp", "webp", 6) == "007-holiday.photo-webp.webp"
    assert one_name(frame, "../{name}:converted", "a?.png", "jpg", "jpeg") == "_a__converted.jpg"
    assert one_name(frame, "", "dir/x.tar", "zip", "zip") == "x-converted.zip"
    assert one_name(frame, "{date}_{total}_{sourceExt}.ZIP", "x.tar", "zip", "zip") == "2024-05-06_9_tar.ZIP"


def brute(names, paren):
    used, out = set(), []
    for name in names:
        folder, file = (name.rsplit("/", 1)[0] + "/", name.rsplit("/", 1)[1]) if paren and "/" in name else ("", name)
        dot = file.rfind(".")
        stem, ext = (file[:dot], file[dot:]) if dot > 0 else (file, "")
        candidate, n = name, 2
        while candidate.lower() in used:
            candidate = folder + stem + (f" ({n})" if paren else f"-{n}") + ext
            n += 1
        used.add(candidate.lower())
        out.append(candidate)
    return out


@pytest.mark.parametrize("paren", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_unique_names_against_brute_force(frame, paren, seed):
    import random

    rnd = random.Random(seed)
    tail = (lambda k: f" ({k})") if paren else (lambda k: f"-{k}")
    names = [rnd.choice(["a", "A", "a", "b"]) + "".join(tail(rnd.randint(1, 7)) for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])))
             + rnd.choice([".txt", ".TXT", ""]) for _ in range(70)]
    if paren:
        names = [rnd.choice(["", "d/", "D/e/"]) + n for n in names]
    df = frame(list(enumerate(names)), "i bigint, n string")
    unique = naming.unique_archive_paths if paren else naming.unique_names
    assert [r["u"] for r in unique(df, "n", "i", "u").orderBy("i").collect()] == brute(names, paren)


def test_plain_repeats(frame):
    df = frame([(0, "file.png"), (1, "FILE.png"), (2, "file.png")], "i bigint, n string")
    assert [r["u"] for r in naming.unique_names(df, "n", "i", "u").orderBy("i").collect()] == ["file.png", "FILE-2.png", "file-3.png"]


ROUTES = [
    ("png", "webp", None, ["browser-image-proof"]), ("jpeg", "jpeg", None, ["browser-image-proof"]), ("mp4", "webm-media", None, ["mediabunny"]),
    ("docx", "odt", "semantic", ["pandoc-document"]), ("docx", "odt", "fidelity", ["libreoffice-document"]),
    ("markdown", "pdf", "fidelity", ["pandoc-document", "libreoffice-document"]),
    ("docm", "pdf", "fidelity", ["pandoc-document", "libreoffice-document"]), ("pdf", "docx", "semantic", ["pdf-reconstruction"]),
    ("xlsx", "ods", "semantic", ["sheetjs-spreadsheet"]), ("xlsx", "pdf", "fidelity", ["libreoffice-document"]),
    ("xlsm", "pdf", "fidelity", ["sheetjs-spreadsheet", "libreoffice-document"]),
    ("xlsx", "parquet", "semantic", ["sheetjs-spreadsheet", "duckdb-data"]), ("parquet", "xlsx", "semantic", ["duckdb-data", "sheetjs-spreadsheet"]),
    ("sqlite", "xlsx", "semantic", ["sqlite-data", "sheetjs-spreadsheet"]), ("xlsx", "sqlite", "semantic", ["sheetjs-spreadsheet", "sqlite-data"]),
    ("csv", "xlsx", "semantic", ["sheetjs-spreadsheet"]), ("fb2", "docx", "semantic", ["fb2-compat", "pandoc-document"]),
    ("rar", "zip", None, ["archive-engine"]), ("avi", "mp4", None, ["ffmpeg-legacy", "mediabunny"]), ("psd", "png", None, ["psd-layered"]),
    ("camera-raw", "jpeg", None, ["raw-preview"]), ("otf", "ttf", None, ["font-compat"]), ("fits", "json-data", None, ["scientific-metadata"]),
    ("jpeg", "docx", "semantic", None),
]


def test_routes(spark):
    edges = routes.conversion_edges(spark)
    found = {p: {(r["source"], r["target"]): [h["converter"] for h in r["hops"]] for r in routes.plan_routes(edges, preference=p).collect()}
             for p in (None, "semantic", "fidelity")}
    for source, target, preference, converters in ROUTES:
        got = found[preference].get((source, target))
        assert (got is None) == (converters is None), (source, target)
        assert converters is None or (got[0], got[-1]) == (converters[0], converters[-1]), (source, target, got)


def test_reachable(spark):
    reach = {}
    for r in routes.available_targets(routes.conversion_edges(spark)).collect():
        reach.setdefault(r["source"], set()).add(r["target"])
    assert "pdf" in reach["jpeg"] and "docx" not in reach["jpeg"] and "zip" not in reach["jpeg"]
    assert {"pdf", "markdown"} <= reach["docx"] and {"zip", "tar-xz"} <= reach["rar"]
    assert not {"psb", "mobi-kindle", "dwg", "hdf5", "glb", "woff2"} & set(reach)


def test_error_wording(frame):
    texts = ["DEVICE_MEMORY_LIMIT: x", "OUTPUT_INVALID: y", "SOMETHING_NEW: odd thing", "plain words", "No local conversion route is available here", None]
    got = [(r["code"], r["title"], r["message"]) for r in batch.classify_errors(
        frame(list(enumerate(texts)), "i int, m string"), "m").orderBy("i").collect()]
    assert got[0][:2] == ("DEVICE_MEMORY_LIMIT", "File is too large for an executor")
    assert got[1][:2] == ("OUTPUT_INVALID", "Output validation failed")
    assert got[2] == ("SOMETHING_NEW", "Conversion could not be completed", "odd thing")
    assert got[3][0] is None and got[3][2] == "plain words"
    assert got[4][0] == "NO_LOCAL_ROUTE" and got[5][2] == batch.FALLBACK[1]


def test_retry_rules(frame):
    tasks = frame([(0, "a", "failed", 1.0, "Cannot plan", "e"), (1, "b", "failed", 1.0, "Failed", None), (2, "c", "completed", 1.0, "Complete", None)],
                  "idx int, source_name string, state string, progress double, stage string, error string")
    assert [r["idx"] for r in batch.select_retry(tasks).collect()] == [1]
    snap = batch.batch_snapshot(tasks).first()
    assert (snap["failed"], snap["completed"], snap["stage"], snap["resumable"], snap["progress"]) == (2, 1, "Batch complete", True, 1.0)
    assert sorted(r["error"] for r in batch.batch_failures(tasks).collect()) == ["Conversion failed.", "e"]


def test_members_that_are_too_large_are_reported(frame):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as out:
        out.writestr("word/document.xml", "<w:p>" * 1000)
        out.writestr("docProps/core.xml", "<dc:title>T</dc:title>")
    files = frame([("a", "docx", bytearray(body.getvalue()))], "archive_id string, format_id string, content binary")
    members = sources.package_members(files, packages.MEMBERS, max_bytes=500)
    found = packages.inspect_packages(members, files).first()
    assert found["package_entries"] == 2 and found["title"] == "T"
    assert [w.split(":")[0] for w in found["warnings"]] == ["PACKAGE_MEMBER_LIMIT"]


def test_archives_stop_at_their_budget(spark):
    bomb = gzip.compress(b"\0" * 20_000_000)
    assert len(bomb) * 900 < 20_000_000
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.bin", b"\0" * 5_000_000)
        z.writestr("dir/small.txt", b"small")
    lies = bytearray(packed.getvalue())
    # the directory states a few bytes for the large member
    at = bytes(lies).index(b"PK\x01\x02")
    lies[at + 24:at + 28] = (7).to_bytes(4, "little")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, size in (("a", 3_000_000), ("b", 10)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"\0" * size))
    rows = [("gz", "x.gz", "gzip", bytearray(bomb)), ("zip", "x.zip", "zip", bytearray(packed.getvalue())), ("lies", "y.zip", "zip", lies),
            ("tar", "x.tgz", "tar-gzip", bytearray(tar.getvalue())), ("fine", "x.gz", "gzip", bytearray(gzip.compress(b"ok")))]
    files = spark.createDataFrame(rows, "archive_id string, name string, format_id string, content binary")
    got = sources.extract_archives(files, member_bytes=2_000_000, archive_bytes=4_000_000).collect()
    errors = {r.archive_id: r.error for r in got if r.error}
    assert set(errors) >= {"gz", "zip", "tar"} and all(e.startswith("ARCHIVE_EXTRACTION_BUDGET") for k, e in errors.items() if k != "lies")
    assert [bytes(r.content) for r in got if r.archive_id == "fine"] == [b"ok"]
    assert not any(r.content and len(r.content) > 2_000_000 for r in got)
    # what is not chosen is not inflated
    chosen = spark.createDataFrame([("zip", "dir/small.txt"), ("lies", "dir/small.txt")], "archive_id string, path string")
    few = sources.extract_archives(files, chosen, member_bytes=100, archive_bytes=100).collect()
    assert sorted((r.archive_id, bytes(r.content)) for r in few) == [("lies", b"small"), ("zip", b"small")]
    # a listing holds no contents and says the size of a single member
    sizes = {r.archive_id: r["size"] for r in sources.scan_archive_entries(files).where("archive_id = 'gz'").collect()}
    assert sizes == {"gz": 20_000_000}


def test_packages_are_decoded_once_and_never_broadcast(spark, frame):
    def epub(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members:
                z.writestr(name, text)
        return bytearray(out.getvalue())

    second = ("b.opf", "<dc:title>Second</dc:title><dc:creator>Bo</dc:creator><itemref /><itemref />")
    files = frame([(1, "epub", epub(("a.opf", "<dc:title>First</dc:title><itemref />"), second, ("META-INF/container.xml", '<r full-path="b.opf"/>'))),
                   (2, "epub", epub(("a.opf", "<dc:title>First</dc:title><itemref />"), second)), (3, "epub", bytearray(b"PK broken"))],
                  "archive_id bigint, format_id string, content binary")
    found = packages.inspect_packages(sources.package_members(files, packages.MEMBERS), files)
    got = {r["archive_id"]: (r["sections"], r["title"], r["author"]) for r in found.collect()}
    assert got == {1: (2, "Second", "Bo"), 2: (1, "First", None), 3: (0, None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInPandas") == 1 and "BroadcastHashJoin" not in plan


def test_heads_of_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "huge.parquet", "wb") as out:  # a sparse file: more than a value can hold
        out.write(b"PAR1abc")
        out.truncate(3 << 30)
    (tmp_path / "small.csv").write_bytes(b"a,b")
    found = {r["name"]: (r["size"], bytes(r["content"])) for r in sources.scan_files(spark, str(tmp_path), 7).collect()}
    assert found == {"huge.parquet": (3 << 30, b"PAR1abc"), "small.csv": (3, b"a,b")}
    assert sources.scan_files(spark, str(tmp_path)).count() == 2


def test_archives_are_bounded(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SHARD_BYTES", 2_000)
    data = frame([(i, f"d{i}.txt", bytearray(b"x" * 500)) for i in range(40)], "idx bigint, path string, content binary")
    for fmt, ending in (("zip", ".zip"), ("tar-gzip", ".tar.gz")):
        folder = tmp_path / fmt
        writers.write_archive_shards(data, str(folder), fmt, shards=1)
        assert len(list(folder.glob("*" + ending))) > 3
        packed = sources.load_files(spark, f"{folder}/*{ending}").select(F.col("path").alias("archive_id"), "content", F.lit(fmt).alias(
            "format_id"))
        got = {(r["path"], bytes(r["content"])) for r in sources.extract_archives(packed).collect()}
        assert got == {(f"d{i}.txt", b"x" * 500) for i in range(40)}
