"""Meshes as vertex and triangle rows: OBJ, STL, PLY."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.ordering import int_range
from tablemill.functions.tables import let, once
from tablemill.functions.text import JS_SPACE, js_number, js_trim, unix_lines

MAX_VERTICES = 2_000_000
MAX_TRIANGLES = 1_500_000
BLANKS = f"{JS_SPACE}+"


def _number(token: Column) -> Column:
    """A finite number, or null."""
    value = F.when(token.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), token.try_cast("double"))
    return let(value, lambda v: F.when(F.abs(v) < float("inf"), v))


def _whole(token: Column) -> Column:
    return let(_number(token), lambda v: F.when(v % 1 == 0, v.cast("bigint")))


def _fan(refs: Column) -> Column:
    """Triangles around the first corner; a face with a bad corner gives one triangle of nulls."""
    nothing = F.lit(None).cast("bigint")
    broken = F.exists(refs, lambda r: r.isNull())
    empty = F.array(F.struct(nothing.alias("a"), nothing.alias("b"), nothing.alias("c")))
    spread = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(refs) - 2, F.lit(1))),
        lambda i: F.struct(F.get(refs, F.lit(0)).alias("a"), F.get(refs, i).alias("b"), F.get(refs, i + 1).alias("c")))
    return F.when(broken, empty).when(F.size(refs) >= 3, spread).otherwise(F.slice(empty, 1, 0))


def _obj_arrays(docs: DataFrame, mesh: str, text: str) -> DataFrame:
    """``(mesh, points, fans)``: every document's vertices and triangles as arrays."""
    def point(line: Column) -> Column:
        return let(F.split(js_trim(F.substring(line, 3, 1 << 30)), BLANKS), lambda t: F.struct(*[
            _number(F.get(t, F.lit(i))).alias(c) for i, c in enumerate("xyz")]))

    def fan(s: Column, k: Column) -> Column:
        # face k at place i of the kept lines has i - k vertices above it
        seen = (s["i"] - k).cast("bigint")

        def ref(token: Column) -> Column:
            index = let(_whole(F.split_part(token, F.lit("/"), F.lit(1))),
                        lambda n: F.when(n > 0, n - 1).when(n < 0, seen + n))
            return let(index, lambda i: F.when((i >= 0) & (i < seen), i))

        return let(F.transform(F.split(js_trim(F.substring(s["l"], 3, 1 << 30)), BLANKS), ref), _fan)

    lines = F.transform(F.split(unix_lines(F.col(text)), "\n"), js_trim)
    kept = once(docs.select(mesh, text), __l=F.filter(lines, lambda v: v.startswith("v ") | v.startswith("f ")))
    faces = F.filter(F.transform("__l", lambda v, i: F.struct(v.alias("l"), i.alias("i"))), lambda s: s["l"].startswith("f "))
    # plain columns: a reader of one array does not compute the other
    return kept.select(mesh, F.transform(F.filter("__l", lambda v: v.startswith("v ")), point).alias("points"),
                       F.flatten(F.transform(faces, fan)).alias("fans"))


def _exploded(arrays: DataFrame, mesh: str) -> tuple[DataFrame, DataFrame]:
    def rows(column: str, names: str) -> DataFrame:
        # the filter that is inferred for an explode would compute the array again, so it is computed first
        held = once(arrays.select(mesh, column), __a=F.col(column))
        return held.select(mesh, F.posexplode("__a").alias("idx", "s")).select(
            mesh, F.col("idx").cast("bigint").alias("idx"), *[f"s.{c}" for c in names])
    return rows("points", "xyz"), rows("fans", "abc")


def parse_obj(docs: DataFrame, mesh: str = "mesh_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``vertices (mesh, idx, x, y, z)`` and ``triangles (mesh, idx, a, b, c)``; what is invalid is null.

    A face may only point to vertices above it, and negative numbers count back from them. Needs no shuffle.
    """
    return _exploded(_obj_arrays(docs, mesh, text), mesh)


VERTEX_PATTERN = re.compile(rb"\bvertex\s+([+\-0-9.eE]+)\s+([+\-0-9.eE]+)\s+([+\-0-9.eE]+)")


def _stl_points(data: bytes) -> np.ndarray:
    """All corners of a binary or ASCII STL file as an ``(n, 3)`` array; what is no number is NaN."""
    count = int.from_bytes(data[80:84], "little") if len(data) >= 84 else -1
    if 0 <= count and 84 + count * 50 <= len(data):
        record = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
        return np.frombuffer(data, record, count, 84)["corners"].reshape(-1, 3).astype("float64")
    found = [[float(v) if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else np.nan for v in m]
             for m in VERTEX_PATTERN.findall(data)]
    return np.array(found, dtype="float64").reshape(-1, 3)


def parse_stl(files: DataFrame, mesh: str = "mesh_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of STL files; every three corners are one triangle."""
    kind = files.schema[mesh].dataType.simpleString()

    def frame(held: list) -> pd.DataFrame:
        points = np.concatenate([chunk for _, _, chunk in held])
        return pd.DataFrame({
            mesh: np.repeat([name for name, _, _ in held], [len(chunk) for _, _, chunk in held]),
            "idx": np.concatenate([np.arange(at, at + len(chunk)) for _, at, chunk in held]),
            "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            for name, data in zip(batch[mesh], batch[content]):
                points = _stl_points(bytes(data))
                for at in range(0, len(points), 100_000):
                    held.append((name, at, points[at:at + 100_000]))
                    rows += len(held[-1][2])
                    if rows >= 100_000:
                        yield frame(held)
                        held, rows = [], 0
        if held:
            yield frame(held)

    raw = files.select(mesh, content).mapInPandas(decode, f"{mesh} {kind}, idx bigint, x double, y double, z double")
    vertices = raw.select(mesh, "idx", *[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
                                         for c in "xyz"])
    corner = F.col("idx")
    triangles = vertices.where(corner % 3 == 2).select(
        mesh, F.floor(corner / 3).cast("bigint").alias("idx"), (corner - 2).alias("a"), (corner - 1).alias("b"),
        corner.alias("c"))
    # corners that make no whole triangle are a triangle that points nowhere, which the guard refuses
    last = vertices.groupBy(mesh).agg(F.max("idx").alias("last")).where((F.col("last") + 1) % 3 != 0)
    nowhere = F.lit(None).cast("bigint")
    torn = last.select(mesh, F.floor(F.col("last") / 3).cast("bigint").alias("idx"), F.col("last").alias("a"),
                       nowhere.alias("b"), nowhere.alias("c"))
    return vertices, triangles.unionByName(torn)


def _ply_arrays(docs: DataFrame, mesh: str, text: str) -> DataFrame:
    """``(mesh, points, fans, error)``; the arrays are null where the header is wrong."""
    def cells(line: Column) -> Column:
        return F.split(js_trim(line), BLANKS)

    def point(line: Column) -> Column:
        return let(cells(line), lambda t: F.struct(*[_number(F.get(t, F.col(f"at_{c}") - 1)).alias(c) for c in "xyz"]))

    def corners(fields: Column, n: Column) -> Column:
        usable = (n >= 3) & (F.size(fields) >= n + 1)
        refs = F.transform(F.slice(fields, F.lit(2), F.coalesce(F.greatest(n, F.lit(0)), F.lit(0))), _whole)
        inside = F.transform(refs, lambda r: F.when((r >= 0) & (r < F.col("n_vertex")), r))
        return F.when(usable, inside).otherwise(F.array().cast("array<bigint>"))

    def fan(line: Column) -> Column:
        refs = let(cells(line), lambda fields: let(
            _whole(F.get(fields, F.lit(0))).cast("int"), lambda n: corners(fields, n)))
        return let(refs, _fan)

    head = ply_headers(docs, mesh, text)
    good = F.col("error").isNull()
    return head.select(
        mesh, F.when(good, F.transform(F.slice("body", F.lit(1), F.col("n_vertex")), point)).alias("points"),
        F.when(good, F.flatten(F.transform(F.slice("body", F.col("n_vertex") + 1, F.col("n_face")), fan))).alias("fans"),
        "error")


def parse_ply(docs: DataFrame, mesh: str = "mesh_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of ASCII PLY files, as the header describes them; short faces are left out."""
    return _exploded(_ply_arrays(docs, mesh, text), mesh)


def mesh_report(docs: DataFrame, fmt: str, mesh: str = "mesh_id", text: str = "text", max_v: int = MAX_VERTICES,
                max_t: int = MAX_TRIANGLES) -> DataFrame:
    """``(mesh, vertices, triangles, error)`` of OBJ or PLY documents, checked in place: one pass and no shuffle."""
    arrays = _ply_arrays(docs, mesh, text) if fmt == "ply" else _obj_arrays(docs, mesh, text).withColumn(
        "error", F.lit(None).cast("string"))
    arrays = once(arrays.select(mesh, "error", "points", "fans"), __p=F.col("points"), __f=F.col("fans")).select(
        mesh, "error", F.col("__p").alias("points"), F.col("__f").alias("fans"))
    nv, nt = F.coalesce(F.size("points"), F.lit(0)), F.coalesce(F.size("fans"), F.lit(0))
    bad_point = F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull())
    bad_face = F.exists("fans", lambda t: t["a"].isNull() | t["b"].isNull() | t["c"].isNull())
    return arrays.select(mesh, nv.cast("bigint").alias("vertices"), nt.cast("bigint").alias("triangles"),
                         F.coalesce("error", _guard_error(nv, nt, bad_point, bad_face, max_v, max_t)).alias("error"))


def _guard_error(nv: Column, nt: Column, bad_point: Column, bad_face: Column, max_v: int, max_t: int) -> Column:
    return (
        F.when(bad_point, "MESH_COORDINATE_INVALID: Non-finite vertex coordinate.")
        .when(bad_face, "MESH_FACE_INVALID: Face index is out of range.")
        .when(nv > max_v, "MESH_COMPLEXITY_LIMIT: Mesh exceeds the guarded vertex limit.")
        .when(nt > max_t, "MESH_COMPLEXITY_LIMIT: Mesh exceeds the guarded triangle limit.")
        .when((nv == 0) | (nt == 0), "MESH_PARSE_FAILED: No triangle geometry."))


def ply_headers(docs: DataFrame, mesh: str = "mesh_id", text: str = "text") -> DataFrame:
    """Header facts per file: counts, positions of x, y and z, body lines, ``error``."""
    lined = once(docs.select(mesh, text), __body=unix_lines(F.col(text))).drop(text)
    placed = once(lined, __end=F.position(F.lit("end_header\n"), F.col("__body")))
    body, end = F.col("__body"), F.col("__end")
    header = F.substring(body, F.lit(1), F.greatest(end - 1, F.lit(0)))
    count = r"(?:^|\n)[ \t]*element[ \t]+{0}[ \t]+(\S+)"
    block = "(?s)" + count + r"[^\n]*\n?(.*?)(?=\n[ \t]*element[ \t]|$)"
    staged = once(
        placed, cut=end == 0, header=header,
        body=F.split(js_trim(F.substring(body, end + len("end_header\n"), F.length(body))), "\n")).drop("__body", "__end")
    props = F.regexp_extract_all(F.regexp_extract("header", block.format("vertex"), 2),
                                 F.lit(r"(?m)^[ \t]*property[ \t]+(?:[^\n]*[ \t])?(\S+)[ \t]*$"), F.lit(1))
    listed = once(staged, __props=props)
    facts = once(
        listed, format=F.regexp_extract("header", r"(?:^|\n)(format [^\n]*)", 1),
        **{f"n_{e}": _whole(F.regexp_extract("header", count.format(e), 1)).cast("int") for e in ("vertex", "face")},
        **{f"at_{c}": F.array_position("__props", c).cast("int") for c in "xyz"}).drop("header", "__props")
    counts = F.coalesce((F.col("n_vertex") >= 1) & (F.col("n_face") >= 1), F.lit(False))
    return once(facts, error=(
        F.when(F.col("cut"), "MESH_PARSE_FAILED: PLY header is incomplete.")
        .when(F.col("format") != "format ascii 1.0", "PLY_BINARY_UNSUPPORTED: Only ASCII PLY is supported.")
        .when(~counts, "MESH_PARSE_FAILED: PLY needs vertex and face elements.")
        .when(F.least("at_x", "at_y", "at_z") == 0, "MESH_PARSE_FAILED: PLY vertex x/y/z properties are required.")
        .when(F.size("body") < F.col("n_vertex") + F.col("n_face"), "MESH_PARSE_FAILED: PLY body is truncated.")))


def mesh_guard(vertices: DataFrame, triangles: DataFrame, max_v: int = MAX_VERTICES, max_t: int = MAX_TRIANGLES,
               mesh: str = "mesh_id") -> DataFrame:
    """``(mesh, vertices, triangles, error)``: numbers that are none, faces out of range, size limits, no geometry."""
    v = vertices.groupBy(mesh).agg(F.count(F.lit(1)).alias("vertices"), F.bool_or(
        F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("bad_point"))
    corners = [F.col(c) for c in "abc"]
    bad = corners[0].isNull() | corners[1].isNull() | corners[2].isNull()
    t = triangles.groupBy(mesh).agg(
        F.count(F.lit(1)).alias("triangles"), F.bool_or(bad | (F.least(*corners) < 0)).alias("bad_face"),
        F.max(F.greatest(*corners)).alias("top"))
    joined = v.join(t, mesh, "full").na.fill(0, ["vertices", "triangles"])
    wrong = F.col("bad_face") | (F.col("top") >= F.col("vertices"))
    return joined.select(mesh, "vertices", "triangles", _guard_error(
        F.col("vertices"), F.col("triangles"), F.col("bad_point"), wrong, max_v, max_t).alias("error"))


WRITER = "tablemill"


@F.pandas_udf(T.BinaryType())
def _pack_triangles(points: pd.Series) -> pd.Series:
    """Nine coordinates per triangle to 50-byte records with a zero normal."""
    record = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])

    def pack(values) -> bytes:
        out = np.zeros(len(values) // 9, record)
        out["corners"] = np.asarray(values, dtype="float64").reshape(-1, 9)
        return out.tobytes()

    return points.map(pack)


def serialize_mesh(vertices: DataFrame, triangles: DataFrame, fmt: str, mesh: str = "mesh_id",
                   rows: int = 10_000) -> DataFrame:
    """The file of each mesh in parts: ``(mesh, section, part, text)``, for STL ``content`` instead of ``text``.

    Put together in ``(section, part)`` order; no part holds more than ``rows`` vertices or triangles. Meshes without
    vertices or triangles are left out.
    """
    counts = vertices.select(mesh, F.lit(1).alias("v"), F.lit(0).alias("t")).union(
        triangles.select(mesh, F.lit(0), F.lit(1))).groupBy(mesh).agg(F.sum("v").alias("nv"), F.sum("t").alias("nt")).where(
        (F.col("nv") > 0) & (F.col("nt") > 0))
    nv, nt = F.col("nv").cast("string"), F.col("nt").cast("string")
    if fmt == "stl":
        name = WRITER.encode() + b" binary STL"
        little = F.unhex(F.regexp_replace(F.lpad(F.hex("nt"), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
        head = counts.select(mesh, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("part"),
                             F.concat(F.lit(bytearray(name.ljust(80, b"\0"))), little).alias("content"))
        corners = triangles.select(mesh, F.col("idx").alias("t"), F.posexplode(F.array("a", "b", "c")).alias("k", "idx"))
        placed = corners.join(vertices, [mesh, "idx"])
        point = F.struct("t", "k", "x", "y", "z")
        packed = placed.groupBy(mesh, int_range("t", rows).alias("part")).agg(F.flatten(F.transform(
            F.array_sort(F.collect_list(point)), lambda p: F.array(p["x"], p["y"], p["z"]))).alias("points"))
        return head.unionByName(packed.select(mesh, F.lit(2).alias("section"), "part",
                                              _pack_triangles("points").alias("content")))
    point = F.concat_ws(" ", *[js_number(F.col(c)) for c in "xyz"])
    if fmt == "obj":
        title = F.lit(f"# Written by {WRITER}\n")
        v_line = F.concat(F.lit("v "), point)
        t_line = F.concat(F.lit("f "), F.concat_ws(" ", *[(F.col(c) + 1).cast("string") for c in "abc"]))
    elif fmt == "ply":
        title = F.concat(
            F.lit(f"ply\nformat ascii 1.0\ncomment written by {WRITER}\nelement vertex "), nv,
            F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement face "), nt,
            F.lit("\nproperty list uchar int vertex_indices\nend_header\n"))
        v_line = point
        t_line = F.concat(F.lit("3 "), F.concat_ws(" ", *[F.col(c).cast("string") for c in "abc"]))
    else:
        raise ValueError(f"MESH_FORMAT_UNSUPPORTED: {fmt}")
    lines = vertices.select(mesh, F.lit(1).alias("section"), "idx", v_line.alias("line")).union(
        triangles.select(mesh, F.lit(2), "idx", t_line))
    sorted_lines = F.sort_array(F.collect_list(F.struct("idx", "line")))["line"]
    parts = lines.groupBy(mesh, "section", int_range("idx", rows).alias("part")).agg(
        F.concat(F.array_join(sorted_lines, "\n"), F.lit("\n")).alias("text"))
    first = (F.col("section") == 1) & (F.col("part") == 0)
    return parts.join(counts, mesh).select(
        mesh, "section", "part", F.when(first, F.concat(title, "text")).otherwise(F.col("text")).alias("text"))
