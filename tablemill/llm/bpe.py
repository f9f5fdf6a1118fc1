"""Byte-level BPE encoding and decoding with given merge ranks.

Every match of the split pattern is encoded by itself. A segment tree over the byte positions of the match holds, for
each range, the least rank of a pair that starts there together with its position, so the root names the leftmost pair
of least rank. A merge joins two live neighbours and changes three leaves: logarithmic work, also for a match of a
million letters. Words repeat, so a bounded cache of encoded units sits in front (see ``units``); the ids are those of
the whole text. Decoding looks the bytes of each id up again.

Defined results: null text counts as empty and has no ids; a text of any length is encoded whole; characters outside the
vocabulary become their bytes, which the vocabulary must hold; an empty table gives an empty result; rows keep their
other columns, and one with the name of the new column gives way to it.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablemill.llm.units import TextEncoder, id_lists, slices


# Held by a Python worker: matches with their ids, and space-separated units with theirs.
PIECES, UNITS = 300_000, 1_300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: base64 of a token, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Ids of one match of the split pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))

    def __call__(self, piece: bytes) -> list[int]:
        ranks, longest = self.ranks, self.longest
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        after, before, none = list(range(1, n + 1)), list(range(-1, n - 1)), len(ranks) * width * 2
        # leaf: rank * width + position, so that equal ranks go by position

        def leaf(i: int) -> int:
            j = after[i]
            if j >= n or after[j] - i > longest:
                return none
            rank = ranks.get(piece[i:after[j]])
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            i = tree[1] % width
            j = after[i]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if tree[width + j] != none:
                put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out


@functools.cache
def text_encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One encoder per Python worker, kept from task to task with what it has seen."""
    import regex

    split, merge = regex.compile(pattern), Merger(load_ranks(ranks_path))

    @functools.lru_cache(PIECES)
    def match_ids(match: str) -> bytes:
        ids = merge(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(text: str) -> bytes:
        return b"".join(map(match_ids, split.findall(text)))

    return TextEncoder(encode, lambda units: [encode(u) for u in units], UNITS)


def _without(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c.lower() != column.lower()])


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(column, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as ``array<int>``."""
    df = _without(df, to)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_encoder(ranks_path, pattern)
        for batch in slices(batches, at):
            lists = id_lists(ids_of.batch(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, to])

    return df.mapInArrow(run, _with(df, to, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids count as none."""
    df = _without(df, to)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [b""] * (1 + max((ranks := load_ranks(ranks_path)).values()))
        for token, rank in ranks.items():
            words[rank] = token
        look = words.__getitem__
        for batch in slices(batches, at):
            lists = batch.column(at)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            out = [b"".join(map(look, flat[a:b].tolist())) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, _with(df, to, T.BinaryType()))
