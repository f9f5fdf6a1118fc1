"""Vector code compression: codebooks by active-entry Lloyd rounds.

Vectors become integers and are cut into equal parts; every part position has a codebook. A round assigns each part to the
nearest entry and replaces the entries by the floored means of their parts; after the rounds all parts are assigned again.

A row keeps the entry of each part and the exact squared distance to it, so a later assignment needs little: a part whose
entry did not move since then compares that distance with the entries that did move, and with no others, since nothing
about these changed. Only parts whose own entry moved scan the whole codebook. Equal distances go to the lower index in
either case. Each round is one pass over the rows with their state and is written; a task adds up its parts itself, so a
round shuffles no more than one small table a task. The driver holds the codebooks, whose size the parameters fix.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a null id comes last
among the seeds and keeps its row; of rows with one id the smaller vector comes first among the seeds; rows repeated in full
have one code each; fewer usable rows than entries make a shorter codebook; an empty table gives an empty result; only the
named columns are read, so others cannot clash. Vectors of different length, a length that the parts do not divide, and
components beyond ``LIMIT`` are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.topk import quantise, usable
from tablemill.session import work_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26  # squares of differences then add up within 64 bits
ROWS = 4096  # rows compared together
STATE = "id bigint, label {label}, v array<bigint>, code binary, far array<bigint>"
SUMS = "part int, entry int, place int, total bigint, n bigint"


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = x[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray) -> None:
    """Bring ``code`` and ``far`` (rows by parts) up to date with the codebooks, of which the ``moved`` entries are new."""
    for p, book in enumerate(books):
        own = moved[p][code[:, p]]
        rescan = np.flatnonzero(own)
        if len(rescan):
            d = _distances(x[rescan, p], book)
            best = d.argmin(axis=1)
            code[rescan, p], far[rescan, p] = best, d[np.arange(len(rescan)), best]
        active, still = np.flatnonzero(moved[p]), np.flatnonzero(~own)
        if len(active) and len(still):
            d = _distances(x[still, p], book[active])
            best = d.argmin(axis=1)
            d, best = d[np.arange(len(still)), best], active[best]
            old, held = far[still, p], code[still, p]
            wins = (d < old) | ((d == old) & (best < held))
            code[still[wins], p], far[still[wins], p] = best[wins], d[wins]


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), parts, -1)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).astype(np.int64)


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _parts(batch.column(2), parts)
                if np.abs(x).max(initial=0) > LIMIT:
                    raise OverflowError(f"VECTOR_OUT_OF_RANGE: a component is beyond {LIMIT} after scaling.")
                code, far = _codes(batch.column(3), parts), batch.column(4).flatten().to_numpy().reshape(-1, parts).copy()
                assign(x, books, moved, code, far)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * parts, pa.int32()), pa.array(far.reshape(-1)))],
                    names=["id", "label", "v", "code", "far"])

    return state.mapInArrow(run, state.schema)


def _moved_to(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floored mean of its parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, code = _parts(batch.column(0), parts), _codes(batch.column(1), parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        spot = [pa.array(np.repeat(a, width).astype(np.int32)) for a in (part, entry)]
        yield pa.RecordBatch.from_arrays(
            [*spot, pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), pa.array(total[part, entry].reshape(-1)),
             pa.array(np.repeat(n[part, entry], width))], names=["part", "entry", "place", "total", "n"])

    new = books.copy()
    sums = state.select("v", "code").mapInArrow(run, SUMS).groupBy("part", "entry", "place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in sums.collect():  # one row for each component of the codebooks
        new[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return new


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` (one byte per part, squared distance) for every usable row, and the codebooks.

    The codebooks are an array (part, entry, place); ``code`` and they give each vector back up to ``error``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("CODEBOOK_SIZE: a codebook has 1 to 256 entries.")
    group = F.col(label) if label else F.lit(None).cast("int")
    rows = _saved(df.where(usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), group.alias("label"), quantise(F.col(vector), scale).alias("v"),
        F.unhex(F.lit("00" * parts)).alias("code"), F.array_repeat(F.lit(0).cast("bigint"), parts).alias("far")), "vectors")
    low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is None:
        return rows.select("id", "label", "code", F.lit(0).cast("bigint").alias("error")), np.empty((parts, 0, 0), np.int64)
    if low != high or low % parts:
        raise ValueError(f"VECTOR_LENGTH: vectors of {low} to {high} components do not make {parts} equal parts.")
    seeds = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    # nothing is assigned yet: every entry counts as moved, so the first pass scans all
    state, moved = rows, np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        state = _saved(_assigned(state, books, moved), "codes")
        new = _moved_to(state, books)
        moved, books = (new != books).any(axis=2), new
    state = _saved(_assigned(state, books, moved), "codes")
    error = F.aggregate("far", F.lit(0).cast("bigint"), lambda s, d: s + d)
    return state.select("id", "label", "code", error.alias("error")), books


def decompress(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with the vector that each code stands for, as a column ``v`` of scaled integers."""
    at = np.arange(len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = books[at, _codes(batch.column("code"), len(books))].reshape(batch.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "v"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(run, f"{fields}, v array<bigint>")
