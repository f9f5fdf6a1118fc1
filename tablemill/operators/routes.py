"""Conversion routes as data: the edge table, reachable targets, cheapest routes and their losses.

The graph has a fixed size (under 90 formats); only ``detected`` file tables grow, and they are joined with the
finished route tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.tables import local_table

class Family(NamedTuple):
    """Edges from every input to every output of one engine."""

    engine: str
    inputs: list[str]
    outputs: dict[str, float]  # target: quality loss
    memory: float  # working memory as a multiple of the input
    cost: int
    cost_of: dict[str, int] = {}  # targets with a cost of their own
    same: float = 0  # quality loss where the format stays
    metadata: list[str] = []  # what gets lost
    streams: str = ""  # the target that is streamed, or "all"
    mode: str = "neutral"
    root_only: bool = False


# The families, in order.
FAMILIES = [
    Family("vips-image", ["jpeg", "png", "webp", "gif", "tiff", "avif", "heic", "jxl", "svg"],
           {"jpeg": 0.12, "png": 0.0, "webp": 0.04, "gif": 0.22, "tiff": 0.0, "avif": 0.04, "jxl": 0.04},
           memory=2, cost=0, root_only=True),
    Family("browser-image-proof", ["jpeg", "png", "webp"],
           {"jpeg": 0.12, "png": 0.0, "webp": 0.04},
           memory=3, cost=4, metadata=["EXIF", "XMP", "ICC"], root_only=True),
    Family("mediabunny", ["mp4", "mov", "webm-media", "mkv", "ogg", "mp3", "wav", "flac", "aac", "mpegts"],
           {"mp4": 0.0, "mov": 0.0, "webm-media": 0.0, "mkv": 0.0, "ogg": 0.0,
            "mp3": 0.0, "wav": 0.0, "flac": 0.0, "aac": 0.0, "mpegts": 0.0},
           memory=1.35, cost=5, streams="all"),
    Family("pdf-engine", ["jpeg", "png"],
           {"pdf": 0.0},
           memory=2, cost=15, metadata=["image metadata"]),
    Family("pdf-engine", ["pdf"],
           {"pdf": 0.0},
           memory=2, cost=5),
    Family("pandoc-document", ["docx", "docm", "odt", "rtf", "html-doc", "markdown",
            "txt", "latex", "typst", "epub", "pptx", "pptm"],
           {"docx": 0.03, "odt": 0.03, "rtf": 0.03, "html-doc": 0.03, "markdown": 0.03,
            "txt": 0.03, "latex": 0.03, "typst": 0.03, "epub": 0.03, "pptx": 0.03},
           memory=4, cost=7, cost_of={"docx": 6, "odt": 8, "epub": 8, "html-doc": 10}, mode="semantic"),
    Family("libreoffice-document", ["doc", "docx", "odt", "rtf", "html-doc", "txt", "epub"],
           {"pdf": 0.0, "docx": 0.015, "doc": 0.015, "odt": 0.015, "rtf": 0.015, "txt": 0.015, "html-doc": 0.015},
           memory=4, cost=5, mode="fidelity"),
    Family("libreoffice-document", ["ppt", "pptx", "odp"],
           {"pdf": 0.0, "pptx": 0.015, "ppt": 0.015, "odp": 0.015, "html-doc": 0.015},
           memory=4, cost=5, mode="fidelity"),
    Family("libreoffice-document", ["xls", "xlsx", "ods", "csv"],
           {"pdf": 0.0, "xlsx": 0.015, "xls": 0.015, "ods": 0.015, "csv": 0.015},
           memory=4, cost=5, mode="fidelity"),
    Family("archive-engine", ["zip", "7z", "rar", "tar", "gzip", "bzip2",
            "xz", "zstd", "tar-gzip", "tar-bzip2", "tar-xz", "cpio"],
           {"zip": 0.0, "7z": 0.0, "tar": 0.0, "tar-gzip": 0.0, "tar-bzip2": 0.0, "tar-xz": 0.0},
           memory=3, cost=18,
           metadata=["archive-specific compression metadata", "unsupported special filesystem entries"], streams="zip"),
    Family("sheetjs-spreadsheet", ["xlsx", "xlsm", "xlsb", "xls", "ods", "fods", "csv", "tsv", "json-data", "jsonl"],
           {"xlsx": 0.02, "xlsb": 0.02, "xls": 0.02, "ods": 0.02,
            "fods": 0.02, "csv": 0.02, "tsv": 0.02, "json-data": 0.02},
           memory=5, cost=8, metadata=["unsupported workbook styling/features"], mode="semantic"),
    Family("duckdb-data", ["csv", "tsv", "json-data", "jsonl", "parquet", "arrow"],
           {"csv": 0.0, "tsv": 0.0, "json-data": 0.0, "jsonl": 0.0, "parquet": 0.0, "arrow": 0.0},
           memory=2, cost=6),
    Family("sqlite-data", ["sqlite"],
           {"sqlite": 0.0},
           memory=3, cost=2, mode="semantic"),
    Family("sqlite-data", ["sqlite"],
           {"csv": 0.0, "tsv": 0.0, "json-data": 0.0, "jsonl": 0.0},
           memory=3, cost=10, metadata=["indexes", "constraints", "triggers", "multiple tables"], mode="semantic"),
    Family("sqlite-data", ["json-data", "jsonl"],
           {"sqlite": 0.0},
           memory=3, cost=10, mode="semantic"),
    Family("psd-layered", ["psd"],
           {"png": 0.0, "jpeg": 0.12, "webp": 0.04},
           memory=6, cost=25, metadata=["layers", "masks", "editable text", "smart objects", "Photoshop editing data"]),
    Family("raw-preview", ["camera-raw"],
           {"jpeg": 0.35},
           memory=2, cost=18, same=0.35, metadata=["RAW sensor data", "develop settings", "full dynamic range"]),
    Family("subtitle-compat", ["srt", "vtt", "ass"],
           {"srt": 0.01, "vtt": 0.01, "ass": 0.01},
           memory=2, cost=4, mode="semantic"),
    Family("mesh-compat", ["obj", "stl", "ply"],
           {"obj": 0.0, "stl": 0.0, "ply": 0.0},
           memory=6, cost=14,
           metadata=["materials", "textures", "normals", "UVs", "colors", "scene hierarchy"], mode="semantic"),
    Family("font-compat", ["ttf", "woff", "eot"],
           {"ttf": 0.0, "woff": 0.0, "eot": 0.0},
           memory=12, cost=10),
    Family("font-compat", ["otf"],
           {"ttf": 0.03},
           memory=12, cost=12, same=0.03, metadata=["OpenType/CFF-specific data"]),
    Family("ffmpeg-legacy", ["avi", "flv", "asf"],
           {"mp4": 0.12, "webm-media": 0.12, "mp3": 0.12, "wav": 0.0, "flac": 0.0, "ogg": 0.12},
           memory=4, cost=80, metadata=["container-specific metadata"]),
    Family("fb2-compat", ["fb2"],
           {"html-doc": 0.08},
           memory=5, cost=16,
           same=0.08, metadata=["embedded images", "FictionBook-specific metadata", "notes/styles"], mode="semantic"),
    Family("scientific-metadata", ["fits"],
           {"json-data": 0.9},
           memory=1, cost=20,
           same=0.9, metadata=["scientific data arrays", "tables", "binary payloads"], mode="semantic", root_only=True),
    Family("pdf-reconstruction", ["pdf"],
           {"txt": 0.45, "markdown": 0.45, "html-doc": 0.45, "docx": 0.45,
            "odt": 0.45, "rtf": 0.45, "latex": 0.45, "typst": 0.45, "epub": 0.45},
           memory=3, cost=90,
           same=0.45, metadata=["page layout", "exact pagination", "fonts", "floating objects", "forms", "annotations"], mode="semantic", root_only=True),
]
# Converters whose loss is the target's own even when the format stays, and the other exceptions.
LOSS_EVEN_IF_SAME = ["vips-image", "browser-image-proof"]
NATIVE_IMAGES = ["jpeg", "png", "webp"]
HEIC_LOSS = ["EXIF", "XMP", "ICC"]
ASS_LOSS = ["styles", "positioning", "effects"]

EDGE_SCHEMA = ("edge_order int, source string, target string, converter string, quality_loss double, "
               "metadata_loss array<string>, multiplier double, streaming boolean, base_cost double, mode string, "
               "root_only boolean")


def conversion_edges(spark: SparkSession) -> DataFrame:
    """One row per edge, expanded from the families."""
    rows = [(order * 1000 + i * 30 + o, source, target, f.engine,
             f.same if source == target and f.engine not in LOSS_EVEN_IF_SAME else loss, f.metadata, f.memory,
             f.streams in ("all", target), float(f.cost_of.get(target, f.cost)), f.mode, f.root_only)
            for order, f in enumerate(FAMILIES) for i, source in enumerate(f.inputs)
            for o, (target, loss) in enumerate(f.outputs.items())]
    edges = local_table(spark, [tuple(float(v) if k in (4, 6) else v for k, v in enumerate(row)) for row in rows], EDGE_SCHEMA)
    losses = (
        F.when((F.col("converter") == "vips-image") & (F.col("source") == "heic"), F.array(*map(F.lit, HEIC_LOSS)))
        .when((F.col("converter") == "subtitle-compat") & (F.col("source") == "ass") & (F.col("target") != "ass"),
              F.array(*map(F.lit, ASS_LOSS)))
        .otherwise(F.col("metadata_loss")))
    both_native = F.col("source").isin(NATIVE_IMAGES) & F.col("target").isin(NATIVE_IMAGES)
    return edges.where(~((F.col("converter") == "vips-image") & both_native)).withColumn("metadata_loss", losses)


def edge_score(preference: str | None = None) -> Column:
    """Cost of one edge: base, 1000 per unit of quality, 25 per metadata loss, 5 per memory multiple, 8 if buffered."""
    score = (F.col("base_cost") + F.col("quality_loss") * 1000 + F.size("metadata_loss") * 25 + F.col("multiplier") * 5
             + F.when(F.col("streaming"), 0).otherwise(8))
    if preference:
        score = score + F.when(F.col("mode").isin("neutral", preference), 0).otherwise(300)
    return F.round(score, 4)


MAX_HOPS = 6


def available_targets(edges: DataFrame, sources: DataFrame | None = None, max_hops: int = MAX_HOPS) -> DataFrame:
    """``(source, target)`` for every target reachable from a source; root-only edges leave the source itself only."""
    starts = (sources if sources is not None else edges).select("source").distinct().coalesce(1)
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("next"), "root_only")
    # staying put is a step too, so that each round reads the one before it only once
    stay = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select(
        "node", F.col("node").alias("next"), F.lit(False).alias("root_only"))
    moves = F.broadcast(step.union(stay))
    allowed = ~F.col("root_only") | (F.col("node") == F.col("source"))
    reach = starts.select("source", F.col("source").alias("node"))
    for _ in range(max_hops):
        reach = reach.join(moves, "node").where(allowed).select("source", F.col("next").alias("node")).distinct()
    # a node counts as target only when an edge leads to it, which is so for the source only if one returns
    return reach.join(F.broadcast(step), "node").where(allowed).select(
        "source", F.col("next").alias("target")).distinct()


def common_targets(edges: DataFrame, detected: DataFrame, batch: str = "batch") -> DataFrame:
    """``(batch, target)`` that every file of the batch can reach; none when a file is unknown.

    The files are first counted per (batch, format), so the join works on at most one row per format of a batch.
    """
    formats = detected.groupBy(batch, "format_id").agg(F.count(F.lit(1)).alias("n"))
    batches = formats.groupBy(batch).agg(
        F.count(F.lit(1)).alias("formats"), F.bool_and(F.col("format_id").isNotNull()).alias("known"))
    # the closure has under 90 x 90 rows whatever the input
    reach = F.broadcast(available_targets(edges).withColumnRenamed("source", "format_id"))
    shared = formats.join(reach, "format_id").groupBy(batch, "target").agg(F.count(F.lit(1)).alias("hits"))
    return shared.join(batches, batch).where(F.col("known") & (F.col("hits") == F.col("formats"))).select(batch, "target")


ROUTE_EDGE = ["edge_order", "source", "target", "converter", "quality_loss", "metadata_loss"]


def plan_routes(edges: DataFrame, pairs: DataFrame | None = None, preference: str | None = None,
                max_hops: int = MAX_HOPS) -> DataFrame:
    """Cheapest route per ``(source, target)``: ``score`` and ``hops`` (array of edges).

    Rounds of relaxation; each keeps the least ``(score, key)`` per pair. The key makes ties fall as in a search that
    settles nodes by score and keeps the first of equals: score of the last node before the target, then that node's
    own key, then the order of the edge.
    """
    scored = edges.withColumn("cost", edge_score(preference))
    edge = F.struct(*ROUTE_EDGE)
    step = scored.select(F.col("source").alias("node"), F.col("target").alias("next"), "cost", "root_only", "edge_order",
                         edge.alias("edge"))
    # staying put costs nothing and adds no hop, so that each round reads the one before it only once
    stay = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select(
        "node", F.col("node").alias("next"), F.lit(0.0).alias("cost"), F.lit(False).alias("root_only"),
        F.lit(None).cast("int").alias("edge_order"), F.lit(None).cast(step.schema["edge"].dataType).alias("edge"))
    moves = F.broadcast(step.unionByName(stay))
    starts = (pairs if pairs is not None else edges).select("source").distinct().coalesce(1)
    no_hops = F.array().cast(T.ArrayType(step.schema["edge"].dataType))
    best = starts.select("source", F.col("source").alias("node"), F.struct(
        F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("key"), no_hops.alias("hops")).alias("b"))
    moved = F.struct(
        F.round(F.col("b.score") + F.col("cost"), 4).alias("score"),
        F.concat(F.array("b.score"), F.col("b.key"), F.array(F.col("edge_order").cast("double"))).alias("key"),
        F.concat("b.hops", F.array("edge")).alias("hops"))
    for _ in range(max_hops):
        onward = best.join(moves, "node").where(
            (~F.col("root_only") | (F.col("node") == F.col("source")))
            & (F.col("edge").isNull() | (F.col("next") != F.col("source"))))
        best = onward.select("source", F.col("next").alias("node"),
                             F.when(F.col("edge").isNull(), F.col("b")).otherwise(moved).alias("b")).groupBy(
            "source", "node").agg(F.min_by("b", F.struct("b.score", "b.key")).alias("b"))
    routes = best.where(F.col("node") != F.col("source")).select(
        "source", F.col("node").alias("target"), "b.score", "b.hops")
    direct = scored.where(F.col("source") == F.col("target")).groupBy("source", "target").agg(
        F.min_by(F.struct("cost", F.struct(*ROUTE_EDGE).alias("edge")), F.struct("cost", "edge_order")).alias("b")).select(
        "source", "target", F.col("b.cost").alias("score"), F.array("b.edge").alias("hops"))
    found = routes.unionByName(direct)
    return found.join(pairs.select("source", "target").distinct(), ["source", "target"]) if pairs is not None else found


# Codes of the loss report. (code, capability that the target lacks, what to say after its name)
LOSS_MESSAGES = [
    ("ALPHA_LOSS", "alpha", " has no alpha channel: see-through pixels get a background."),
    ("ANIMATION_LOSS", "animation", " holds one frame: choose which frame of an animation to keep."),
    ("PAGE_LOSS", "multiple_pages", " holds one picture: further pages are left out."),
    ("HDR_LOSS", "hdr", " has a narrow brightness range: highlights may be compressed."),
    ("VECTOR_RASTERIZATION", "vector", "Shapes turn into pixels at the size they are drawn."),
]
LOSSY = "Some step on this route compresses with loss; choose a lossless setting where exact values matter."


def analyze_loss(routes: DataFrame, formats: DataFrame) -> DataFrame:
    """Add ``losses``: array of ``struct<code, message>`` from capabilities, metadata and quality along the route."""
    caps = ["name", "alpha", "animation", "hdr", "multiple_pages", "vector"]
    side = {s: F.broadcast(formats.select(F.col("format_id").alias(s), F.struct(*caps).alias(f"__{s}")))
            for s in ("source", "target")}
    joined = routes.join(side["source"], "source").join(side["target"], "target")
    a, b = F.col("__source"), F.col("__target")
    found = []
    for code, cap, text in LOSS_MESSAGES:
        test = a[cap] & ~b[cap]
        if code == "PAGE_LOSS":
            test = test & ~b["animation"]
        message = F.lit(text) if code == "VECTOR_RASTERIZATION" else F.concat(b["name"], F.lit(text))
        found.append(F.when(test, F.struct(F.lit(code).alias("code"), message.alias("message"))))
    metadata = F.array_distinct(F.flatten(F.transform("hops", lambda h: h["metadata_loss"])))
    quality = F.aggregate("hops", F.lit(0.0), lambda acc, h: acc + h["quality_loss"])
    found.append(F.when(F.size(metadata) > 0, F.struct(
        F.lit("METADATA_LOSS").alias("code"),
        F.concat(F.lit("Lost on this route: "), F.array_join(metadata, ", "), F.lit(".")).alias("message"))))
    found.append(F.when(quality > 0, F.struct(F.lit("LOSSY_ROUTE").alias("code"), F.lit(LOSSY).alias("message"))))
    return joined.withColumn("losses", F.array_compact(F.array(*found))).drop("__source", "__target")
