"""Elements of a large JSON array, cut by many tasks.

A file is read in pieces between commas, which the text source splits by byte ranges like lines. Two things say where an element
starts: a comma outside of strings at depth 1. Whether a piece starts in a string is a prefix sum of quotes modulo 2; its depth
is a prefix sum of brackets outside of strings, once that bit is known. A block of pieces therefore is a small function (its
quotes, and its brackets for either start), and blocks are composed by a window over one row per block.

A block is read by one task, in order. A first pass gives one row per block, a second one, which knows the state before its
blocks, cuts each into its elements and numbers them; neither shuffles a piece. Only the first and last element of a block may
go on in another one, and only those are shuffled and put together afterwards. One row per block is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions.text import js_trim, plain_path, strip_bom
from tablemill.session import work_path

STEP = np.zeros(256, np.int64)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
SIGN = STEP != 0
SIGN[[ord('"'), ord("\\")]] = True

BLOCKS = "file string, block bigint, quotes bigint, if_out bigint, if_in bigint"
CUT = "file string, block bigint, seq bigint, text string, sound boolean, first boolean, after bigint, string bigint, edge boolean"


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(spark: SparkSession, path: str | list[str], over: int) -> DataFrame:
    """``file, block, value``, in the order of the file within a block."""
    return spark.read.text(path, lineSep=",").where(F.col("_metadata.file_size") > over).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First and end of the rows of one block."""
    file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows])


def _signs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes and of the brackets, and the steps of the latter; what a backslash escapes is neither."""
    codes = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(SIGN[codes])
    kind = codes[at]
    slashes = at[kind == ord("\\")]
    if len(slashes):
        ends = np.flatnonzero(np.append(np.diff(slashes) > 1, True))
        odd = np.diff(ends, prepend=-1) % 2 == 1
        free = ~np.isin(at, slashes[ends[odd]] + 1)
        at, kind = at[free], kind[free]
    step = STEP[kind]
    return at[kind == ord('"')], at[step != 0], step[step != 0]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: its quotes, and its brackets where it starts outside of a string or in one."""
    key, quotes, sums = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "quotes": quotes, "if_out": sums[0], "if_in": sums[1]}],
                                          pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "quotes", "if_out", "if_in"))]))

    for batch in batches:
        values = batch.column(2).cast(pa.binary())
        for a, b in _runs(batch):
            here = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            if here != key:
                if key:
                    yield row()
                key, quotes, sums = here, 0, [0, 0]
            found, at, step = _signs(b",".join(values.slice(a, b - a).to_pylist()))
            bit = (np.searchsorted(found, at) + quotes) % 2
            for start in (0, 1):
                sums[start] += int(step[bit == start].sum())
            quotes += len(found)
    if key:
        yield row()


class _Cutter:
    """The elements of one block; ``rows`` has those that have ended."""

    def __init__(self, file: str, block: int, bit: int, depth: int):
        self.file, self.block, self.bit, self.depth = file, block, bit, depth
        self.rows: list[tuple] = []
        self.begun, self.seq = False, -1
        self._open(False)

    def _open(self, first: bool) -> None:
        self.parts: list[bytes] = []
        self.sound, self.first = True, first

    def _close(self, after: int, string: int, edge: bool) -> None:
        seq = self.seq if self.seq >= 0 else None
        self.rows.append((self.file, self.block, seq, b",".join(self.parts), self.sound, self.first, after, string, edge or seq is None))

    def add(self, values: list[bytes]) -> None:
        data = b",".join(values)
        quotes, at, step = _signs(data)
        outside = (np.searchsorted(quotes, at) + self.bit) % 2 == 0
        at, depths = at[outside], self.depth + np.concatenate([[0], np.cumsum(step[outside])])
        starts = np.cumsum([0, *(len(v) + 1 for v in values)])
        depth, string = depths[np.searchsorted(at, starts)], (np.searchsorted(quotes, starts) + self.bit) % 2
        before, after = depth[:-1], depth[1:]
        new = (before == 1) & (string[:-1] == 0)
        # outside of the array there is nothing but its first bracket, and an element ends where the next begins
        sound = (after >= 0) & (before > 0)
        first = self.block == 0 and not self.begun
        if first:
            new[0], sound[0] = True, after[0] >= 0
        self.begun = True
        edges = [0, *np.flatnonzero(new).tolist(), len(values)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if i:
                if self.parts:
                    self._close(int(depth[a]), int(string[a]), False)
                self.seq += 1
                self._open(first and a == 0)
            if a < b:
                self.parts.append(data[starts[a]:starts[b] - 1])
                self.sound = self.sound and bool(sound[a:b].all())
        self.bit, self.depth = int(string[-1]), int(depth[-1])

    def end(self) -> None:
        self._close(self.depth, self.bit, True)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["file", "block", "seq", "text", "sound", "first", "after", "string", "edge"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        columns[3] = columns[3].view(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    cutter = None
    for batch in batches:
        values = batch.column(2).cast(pa.binary())
        for a, b in _runs(batch):
            here = [batch.column(c)[a].as_py() for c in (0, 1, 3, 4)]
            if cutter is None or [cutter.file, cutter.block] != here[:2]:
                if cutter is not None:
                    cutter.end()
                    yield made(cutter.rows)
                cutter = _Cutter(*here)
            cutter.add(values.slice(a, b - a).to_pylist())
        if cutter is not None and cutter.rows:
            yield made(cutter.rows)
            cutter.rows = []
    if cutter is not None:
        cutter.end()
        yield made(cutter.rows)


def _starts(pieces: DataFrame) -> DataFrame:
    """``file, block, bit, depth`` before the first piece of every block."""
    blocks = pieces.mapInArrow(_summed, BLOCKS)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bits = blocks.withColumn("bit", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    chosen = F.when(F.col("bit") == 0, F.col("if_out")).otherwise(F.col("if_in"))
    return bits.select("file", "block", "bit", F.coalesce(F.sum(chosen).over(earlier), F.lit(0)).alias("depth"))


def array_elements(spark: SparkSession, path: str | list[str], over: int) -> DataFrame:
    """``file, block, seq, text, sound, closed, first`` for the files of more than ``over`` bytes.

    ``block, seq`` order the elements of a file, ``seq`` counting those that start in a block; ``sound`` says whether the brackets
    around and inside the element are those of one array. Texts are cut, not parsed; an empty array is one blank element.
    """
    pieces = _pieces(spark, path, over)
    starts = _saved(_starts(pieces), "json-starts")
    known = pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "bit", "depth")
    cut = _saved(known.mapInArrow(_elements, CUT), "json-cut")
    ended = F.struct("after", "string").alias("end")
    whole = cut.where("NOT edge").select("file", "block", "seq", "text", "sound", "first", ended)

    last = cut.where("edge").groupBy("file", "block").agg(F.max("seq").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file", "block", F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias(
        "seq"))), ignorenulls=True).over(earlier).alias("carried"))
    parts = cut.where("edge").join(carry, ["file", "block"]).select(
        "file", F.when(F.col("seq").isNull(), F.col("carried")).otherwise(F.struct("block", "seq")).alias("own"),
        F.struct("block", "text").alias("part"), "sound", "first", ended)
    joined = parts.groupBy("file", "own").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), ",").alias("text"),
        F.bool_and("sound").alias("sound"), F.bool_or("first").alias("first"), F.max_by("end", "part.block").alias("end")).select(
        "file", "own.block", "own.seq", "text", "sound", "first", "end")
    elements = whole.unionByName(_saved(joined, "json-joined"))
    opened = js_trim(strip_bom(F.col("text")))
    text = F.when(F.col("first"), F.regexp_replace(opened, r"^\[", "")).otherwise(F.col("text"))
    closed = F.col("end.after") == 0
    return elements.select(
        "file", "block", "seq",
        F.when(closed, F.regexp_replace(js_trim(text), r"\]\z", "")).otherwise(text).alias("text"),
        (F.col("sound") & (F.col("end.string") == 0) & F.col("end.after").isin(0, 1) & (~F.col("first") | opened.startswith("["))
         & (~closed | js_trim(F.col("text")).endswith("]"))).alias("sound"), closed.alias("closed"), "first")


def numbered(elements: DataFrame) -> DataFrame:
    """``elements`` of whole files with their ``row_index`` in each file."""
    counts = elements.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return elements.join(F.broadcast(_saved(offsets, "json-offsets")), ["file", "block"]).withColumn(
        "row_index", F.col("offset") + F.col("seq"))
