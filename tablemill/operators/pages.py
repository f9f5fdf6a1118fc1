"""Text of pages: lines from positioned runs, documents from pages, page-range specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.ordering import ordered_parts
from tablemill.functions.tables import once
from tablemill.functions.text import JS_SPACE, js_trim

JS_BLANKS = re.compile(JS_SPACE + "+")
LINE_SCHEMA = "doc {doc}, page {page}, band bigint, line int, y double, text string"
PACK_SCHEMA = "doc {doc}, page {page}, n int, size int, runs binary"
PACK = 64 << 10  # bytes of runs in a pack, or one run
TOGETHER = 2 << 20  # bytes of whole pages that are unpacked together, or one page


def pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring runs ``(doc, page, seq, x, y, str)`` of one page as one compressed row."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        for column in (0, 1):
            key = batch.column(column).to_numpy(zero_copy_only=False)
            differs = key[1:] != key[:-1]
            new[1:] = differs if column == 0 else new[1:] | differs
        text = batch.column(5).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data, sizes = memoryview(text.buffers()[2]), np.diff(ends).astype("<i4")
        new[1:] |= np.diff(np.cumsum(sizes.astype(np.int64) + 28) // PACK) > 0
        starts = np.flatnonzero(new)
        # numbers in order have steps that repeat
        steps = np.diff(batch.column(2).to_numpy(), prepend=0)
        steps[starts] = batch.column(2).to_numpy()[starts]
        numbers = [steps, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))]
        packs = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(new)]):
            packs.append(b"".join([*(c[a:b].tobytes() for c in numbers), sizes[a:b].tobytes(), data[ends[a]:ends[b]]]))
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.diff(np.append(starts, len(new))), pa.int32()),
             pa.array([len(p) for p in packs], pa.int32()), pa.array([codec.compress(p, asbytes=True) for p in packs], pa.binary())],
            names=["doc", "page", "n", "size", "runs"])


def unpack_runs(packs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``seq, x, y, str`` of the packs' runs, one after the other."""
    codec = pa.Codec("zstd")
    found: list[list] = [[], [], [], [], []]
    for n, size, body in zip(*(packs.column(k).to_pylist() for k in (2, 3, 4))):
        body = codec.decompress(body, size, asbytes=True)
        parts = [np.cumsum(np.frombuffer(body, "<i8", n)), *(np.frombuffer(body, "<f8", n, 8 * n * k) for k in (1, 2)),
                 np.frombuffer(body, "<i4", n, 24 * n), body[28 * n:]]
        for column, part in zip(found, parts):
            column.append(part)
    seq, x, y, sizes = (np.concatenate(c) for c in found[:4])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(b"".join(found[4])))
    return seq, x, y, text


def reconstruct_lines(runs: DataFrame, tolerance: float = 2.0, chunk: int = 20_000) -> DataFrame:
    """``(doc, page, band, line, text)`` from runs ``(doc, page, seq, x, y, str)``, top down by ``(band, line)``.

    A run joins the first line whose anchor (its first run) is within ``tolerance``. Runs more than that apart in
    height never meet, so a page is first cut into bands at such gaps. Pages of at most ``chunk`` runs are shuffled once,
    neighbouring runs packed and compressed as one row, and cut into bands where they are whole. The bands of larger pages are
    found on their distinct heights alone, shuffled in chunks of about ``chunk`` runs and go through Python as sorted streams,
    one band held at a time. One row per larger page is broadcast. Runs without a doc, a page or a height have no line.
    """
    used = runs.where(F.length("str") > 0)
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = LINE_SCHEMA.format(doc=types["doc"], page=types["page"])
    packed = isinstance(runs.schema["seq"].dataType, T.IntegralType)
    placed = used.where("doc IS NOT NULL AND page IS NOT NULL AND y IS NOT NULL")
    large = F.broadcast(placed.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("doc", "page"))
    if packed:
        used = used.join(large, ["doc", "page"], "left_semi")
    heights = used.groupBy("doc", "page", "y").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("doc", "page").orderBy(F.desc("y"))
    gap = F.coalesce((F.lag("y").over(down) - F.col("y") > tolerance).cast("bigint"), F.lit(0))
    bands = heights.withColumn("gap", gap).withColumn("above", F.sum("n").over(down) - F.col("n")).withColumn(
        "band", F.sum("gap").over(down))
    start = F.min("above").over(Window.partitionBy("doc", "page", "band"))
    bands = bands.withColumn("chunk", F.floor(start / chunk)).select("doc", "page", "y", "band", "chunk")

    def order(x, y) -> np.ndarray:
        """Reading order: higher first where heights differ by more than the tolerance, else left first."""
        def compare(i: int, j: int) -> float:
            drop = y[j] - y[i]
            return drop if abs(drop) > tolerance else x[i] - x[j]
        return np.array(sorted(range(len(x)), key=cmp_to_key(compare)), dtype=np.int64)

    def joined(words: list[str]) -> str:
        return JS_BLANKS.sub(" ", " ".join(words)).strip(" ")

    def lines(x, y, text) -> list[tuple[float, str]]:
        sequence = order(x, y)
        # the line of each run is the earliest anchor that is near enough
        anchors, line_of = [y[sequence[0]]], np.zeros(len(x), np.int64)
        for i in sequence[1:]:
            near = np.flatnonzero(np.abs(np.array(anchors) - y[i]) <= tolerance)
            line_of[i] = near[0] if len(near) else len(anchors)
            if not len(near):
                anchors.append(y[i])
        words = [[] for _ in anchors]
        for i in sequence:
            words[line_of[i]].append(text[i])
        return [(float(anchors[k]), joined(words[k])) for k in np.argsort(-np.array(anchors), kind="stable")]

    def lines_of(x: np.ndarray, y: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[tuple, ...]:
        """Band, line, height and text of whole bands' lines; bands within the tolerance are one line, sorted from left to right all at once."""
        sizes = np.diff(np.append(starts, len(x)))
        flat = np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts) <= tolerance
        left = np.lexsort((x, np.repeat(np.arange(len(starts)), sizes)))
        text, words, heights = text.tolist(), text[left].tolist(), y[left[starts]].tolist()
        out = []
        for k, (a, n, one) in enumerate(zip(starts.tolist(), sizes.tolist(), flat.tolist())):
            if one:
                out.append((k, 0, heights[k], joined(words[a:a + n])))
            else:
                out += [(k, i, height, line) for i, (height, line) in enumerate(lines(x[a:a + n], y[a:a + n], text[a:a + n]))]
        return tuple(zip(*out))

    def bands_of(rows: pd.DataFrame, starts: np.ndarray, end: int) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(float)[:end], rows["y"].to_numpy(float)[:end]
        band, line, height, content = lines_of(x, y, rows["str"].to_numpy()[:end], starts)
        found = rows[["doc", "page", "band"]].iloc[starts[list(band)]].reset_index(drop=True)
        return found.assign(line=np.array(line), y=np.array(height), text=list(content))

    def pages_of(packs: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        """The lines of whole pages; ``first`` tells the packs that open one."""
        seq, x, y, text = unpack_runs(packs)
        page = np.repeat(np.cumsum(first) - 1, packs.column(2).to_numpy())
        down = np.lexsort((-y, ~np.isnan(y), page))
        p, above, below = page[down], y[down][:-1], y[down][1:]
        gap = (above != below) & ~(np.isnan(above) & np.isnan(below)) & ~(above - below <= tolerance)
        band_of = np.empty(len(y), np.int64)
        band_of[down] = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]) | gap]))
        order = np.lexsort((seq, band_of))
        starts = np.flatnonzero(np.diff(band_of[order], prepend=-1))
        band, line, height, content = lines_of(x[order], y[order], text.take(pa.array(order)).to_numpy(zero_copy_only=False), starts)
        page = page[order[starts]]
        opens = np.searchsorted(page, page)  # the first band of each band's page
        band = np.array(band)
        at = pa.array(np.flatnonzero(first)[page[band]])
        return pa.RecordBatch.from_arrays(
            [packs.column(0).take(at), packs.column(1).take(at), pa.array(band - opens[band], pa.int64()), pa.array(line, pa.int32()),
             pa.array(height, pa.float64(), from_pandas=True), pa.array(content, pa.string())], names=["doc", "page", "band", "line", "y", "text"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            packs = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
            if packs is None or not packs.num_rows:
                continue
            first = np.ones(packs.num_rows, bool)
            for column in (0, 1):
                key = packs.column(column).to_numpy(zero_copy_only=False)
                differs = key[1:] != key[:-1]
                first[1:] = differs if column == 0 else first[1:] | differs
            starts, end = np.flatnonzero(first), packs.num_rows
            # the last page may go on in the next batch
            held = None
            if batch is not None:
                held, end, starts = packs.slice(int(starts[-1])), int(starts[-1]), starts[:-1]
            before = np.cumsum(packs.column(3).to_numpy(), dtype=np.int64) - packs.column(3).to_numpy()
            cuts = starts[np.diff(before[starts] // TOGETHER, prepend=-1) > 0].tolist()
            for a, b in zip(cuts, [*cuts[1:], end]):
                yield pages_of(packs.slice(a, b - a), first[a:b])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in chain(batches, [None]):
            rows = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or rows.empty:
                continue
            new = np.ones(len(rows), bool)
            for name in ("doc", "page", "band"):
                key = rows[name].to_numpy()
                new[1:] = key[1:] != key[:-1] if name == "doc" else new[1:] | (key[1:] != key[:-1])
            starts, end = np.flatnonzero(new), len(rows)
            # the last band may go on in the next batch
            held = None
            if batch is not None:
                held, end, starts = rows.iloc[starts[-1]:].reset_index(drop=True), int(starts[-1]), starts[:-1]
            if len(starts):
                yield bands_of(rows, starts, end)

    keyed = used.join(bands, ["doc", "page", "y"]).select("doc", "page", "chunk", "band", "seq", "x", "y", "str")
    ordered = keyed.repartition("doc", "page", "chunk").sortWithinPartitions("doc", "page", "band", "seq")
    lines_of_large = ordered.drop("chunk", "seq").mapInPandas(decode, schema)
    if not packed:
        return lines_of_large
    # a missing number comes first
    number = F.coalesce(F.col("seq").cast("bigint"), F.lit(-1 << 63))
    small = placed.join(large, ["doc", "page"], "left_anti").select(
        "doc", "page", number.alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "str")
    packs = small.mapInArrow(pack_runs, PACK_SCHEMA.format(doc=types["doc"], page=types["page"]))
    dealt = packs.repartition("doc", "page").sortWithinPartitions("doc", "page")
    return dealt.mapInArrow(unpack, schema).unionByName(lines_of_large)


def assemble_pages(pages: DataFrame, mode: str = "text", doc: str = "doc", page: str = "page", text: str = "text",
                   rows: int = 10_000) -> DataFrame:
    """``(doc, part, text)``: pages in order, joined by a blank line or as Markdown with page marks and rules."""
    if mode == "markdown":
        piece = F.concat(F.lit("<!-- Page "), F.col(page).cast("string"), F.lit(" -->\n\n"), js_trim(F.col(text)))
        return ordered_parts(pages, [doc], page, piece, "\n\n---\n\n", rows)
    return ordered_parts(pages, [doc], page, F.col(text), "\n\n", rows)


INVALID = "PDF_PAGE_RANGE_INVALID"
RANGE = r"^(\d+)(?:-(\d+))?$"


def _pages_of(spec: Column, last: Column) -> Column:
    """``struct<pages, error>`` of one specification: ordered distinct pages, or the first thing wrong with it."""
    value = F.lower(js_trim(spec))
    tokens = F.filter(F.transform(F.split(value, ","), js_trim), lambda v: v != "")

    def bounds(token: Column) -> tuple[Column, Column]:
        start = F.regexp_extract(token, RANGE, 1).try_cast("bigint")
        return start, F.coalesce(F.nullif(F.regexp_extract(token, RANGE, 2), F.lit("")).try_cast("bigint"), start)

    def wrong(token: Column) -> Column:
        start, end = bounds(token)
        bad = (F.when((start < 1) | (start > last), start).when((start <= end) & (end > last), last + 1)
               .when((start > end) & (end < 1), F.lit(0)))
        return F.when(~token.rlike(RANGE), F.concat(F.lit(f"{INVALID}: Invalid page token "), token)).when(
            bad.isNotNull(), F.concat(F.lit(f"{INVALID}: Page "), bad.cast("string"), F.lit(" is outside 1-"),
                                      last.cast("string"), F.lit(".")))

    everything = (value == "") | (value == "all")
    error = (
        F.when(everything, F.lit(None).cast("string"))
        .when(F.size(tokens) == 0, f"{INVALID}: No pages selected.")
        .otherwise(F.get(F.filter(F.transform(tokens, wrong), lambda e: e.isNotNull()), F.lit(0))))
    chosen = F.array_distinct(F.flatten(F.transform(tokens, lambda v: F.sequence(*bounds(v)))))
    pages = F.when(error.isNotNull(), F.lit(None)).when(
        everything, F.when(last >= 1, F.sequence(F.lit(1).cast("bigint"), last))).otherwise(chosen)
    return F.struct(pages.alias("pages"), error.alias("error"))


def expand_page_specs(df: DataFrame, spec_col: str, max_col: str, groups: bool = True) -> DataFrame:
    """One row per selected page: adds ``part, part_name, pos, page, error``; a broken group has one row with its error.

    ``;`` splits groups (outputs of a split), numbered from 1.
    """
    last = F.col(max_col).cast("bigint")
    parts = F.filter(F.split(js_trim(F.col(spec_col)), ";"), lambda g: g != "") if groups else F.array(spec_col)
    parts = F.when(F.size(parts) == 0, F.array(F.lit("all"))).otherwise(parts)
    grouped = df.select("*", F.posexplode(parts).alias("__g", "__spec"))
    expanded = once(grouped, __r=_pages_of(F.col("__spec"), last))
    return expanded.select(
        *df.columns, (F.col("__g") + 1).alias("part"),
        F.concat(F.lit("-part-"), F.lpad((F.col("__g") + 1).cast("string"), 3, "0")).alias("part_name"),
        F.col("__r.error").alias("error"), F.posexplode_outer("__r.pages").alias("pos", "page"))
