"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

1. ``tokenise`` encodes every document once, ends it with id 0, cuts what is longer than a sequence and writes the pieces.
   Full pieces are sequences already.
2. ``place`` deals the other pieces into tasks of about ``TASK_ITEMS``; each task packs its own by best fit, largest
   first. Bins with at most ``SLACK`` free places are final. Underfull bins go on as items of the next round, whose tasks
   take them from several earlier ones, until one task has taken all that is left or a round saves less than one bin in a
   hundred. No task ever holds more than its bounded share, and only (id, length) pairs are shuffled.

Defined results: null or empty text is one piece, the end id; a text of any length is cut whole; equal lengths are taken
by piece id; documents repeated in full are packed each; an empty table gives an empty result; only the key and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.units import GROUP, Recent, TextEncoder, slices
from tablemill.session import work_path

CAPACITY = 2048
END = (0).to_bytes(4, "little")
TASK_ITEMS = 20_000
SLACK = 8
JOINED = 2000  # unknown units encoded by one call of the library
CACHED = 800_000  # units that a Python worker holds
WORDS = 800_000  # words and runs of signs that it holds
SLICE = 8 << 20  # bytes of texts encoded between two batches of pieces
# A word of Latin letters and signs that can only be a piece of their own, and perhaps the same on the next line.
LETTERS, SIGNS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", "[.,;:!?]{0,4}"
PLAIN = rf"\A(?P<word> {LETTERS})(?P<signs>{SIGNS})(?:\n(?P<more>{LETTERS})(?P<last>{SIGNS}))?\z"
SPACE = "\u0120"  # how the vocabulary spells a leading space

PIECES = "doc_id {key}, piece int, start bigint, length bigint, piece_id bigint, ids binary"
BIN = "fill int, members array<struct<piece_id:bigint,length:int>>"


def tokenise(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
             part: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, piece_id, ids`` (32-bit little endian).

    With ``part`` a worker holds that part of the usual words, units and texts, for executors that other steps fill too.
    """
    schema = PIECES.format(key=df.schema[key].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary, part)
        number, step = TaskContext.get().partitionId() << 40, capacity * 4
        for batch in slices(batches, 1, SLICE // part):
            out: list[list] = [[], [], [], [], [], []]
            for k, ids in zip(batch.column(0), encode.batch(batch.column(1).to_pylist())):
                ids += END
                at, end = 0, len(ids) % step or step
                while at < len(ids):
                    row = (k.as_py(), (at + step - 1) // step, at // 4, (end - at) // 4, number, ids[at:end])
                    for column, value in zip(out, row):
                        column.append(value)
                    number, at, end = number + 1, end, end + step
            yield _batch(out, batch.schema.field(0).type)
        # the worker lives on, what Arrow keeps for it need not
        pa.default_memory_pool().release_unused()

    path = work_path(df.sparkSession, "pieces")
    pieces = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)
    pieces.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


@functools.cache
def library_encoder(vocabulary: str, part: int = 1) -> TextEncoder:
    """One encoder per Python worker, kept from task to task with what it has seen."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenize = tokenizer.model.tokenize
    names = tokenizer.get_vocab(with_added_tokens=True)
    opens = np.zeros(max(names.values()) + 1, bool)
    for name, number in names.items():
        opens[number] = name.startswith(SPACE)
    # byte-level vocabularies spell visible bytes as themselves and the others as the letters from 256 on
    hidden = (b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))
    spelling = [chr(b) for b in range(256)]
    for n, b in enumerate(hidden):
        spelling[b] = chr(256 + n)

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(text: str) -> bytes:
        spelled = SPACE + text[1:] if text.isascii() and text[:1] == " " else "".join(map(spelling.__getitem__, text.encode()))
        return array("I", [token.id for token in tokenize(spelled)]).tobytes()

    words = Recent(lambda texts: list(map(piece, texts)), WORDS // part)

    def many(units: list[str]) -> list[bytes]:
        """Plain words and their signs are pieces each, so each different one is encoded once; other units through all."""
        found = pc.extract_regex(pa.array(units, pa.string()), PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        word, signs, more, last = found.drop_null().flatten()
        out: list[bytes] = [b""] * len(units)
        others = np.flatnonzero(~plain).tolist()
        for i, ids in zip(others, joined([units[i] for i in others])):
            out[i] = ids
        if len(word):
            line = pc.if_else(pc.equal(more, ""), "", "\n")
            coded = pa.concat_arrays([word, signs, line, more, last]).dictionary_encode()
            # the pieces of a unit follow each other
            number = words.numbers(coded).reshape(5, -1).T.ravel()
            ids, ends = words.gather(number, words.sizes[number])
            ends = [0, *(ends[4::5] * 4).tolist()]
            for i, a, b in zip(np.flatnonzero(plain).tolist(), ends, ends[1:]):
                out[i] = ids[a:b]
        return out

    def joined(units: list[str]) -> list[bytes]:
        # a text of units has exactly one token that opens with the space for each of them
        out: list[bytes] = []
        for at in range(0, len(units), JOINED):
            text = "".join(units[at:at + JOINED])
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = [*(np.flatnonzero(opens[ids])[1:] * 4).tolist(), len(ids) * 4]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    return TextEncoder(whole, many, CACHED // part, GROUP // part)


def _batch(out: list[list], key: pa.DataType) -> pa.RecordBatch:
    types = [key, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                      names=["doc_id", "piece", "start", "length", "piece_id", "ids"])


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, used = 0, 0  # bit r: some bin has r places free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = present >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            target = free[room].pop()
            if not free[room]:
                present ^= 1 << room
        else:
            room, target, used = capacity, used, used + 1
        bins[i] = target
        room -= size
        free[room].append(target)
        present |= 1 << room
    return bins


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """One task of one round: items in, bins out, the members of an item staying together."""
    table = table.combine_chunks().sort_by([("fill", "descending"), ("id", "ascending")])
    fill = table.column("fill").to_numpy()
    bins = best_fit(fill, capacity)
    order = np.argsort(bins, kind="stable")
    members = table.column("members").combine_chunks().take(pa.array(order))
    members = members.combine_chunks() if isinstance(members, pa.ChunkedArray) else members
    per_item = members.value_lengths().to_numpy()
    per_bin = np.bincount(bins[order], weights=per_item).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(per_bin)]), pa.int32())
    flat = members.flatten()
    # built anew, so that nothing is declared as never null
    flat = pa.StructArray.from_arrays([flat.field(0), flat.field(1)], names=["piece_id", "length"])
    return pa.table({"fill": pa.array(np.bincount(bins, weights=fill).astype(np.int32)),
                     "members": pa.ListArray.from_arrays(offsets, flat)})


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``piece_id, sequence_id, offset`` of the pieces shorter than a sequence; a sequence is named by its first piece."""
    spark = pieces.sparkSession
    partial = pieces.where(F.col("length") < capacity)
    items = partial.select(F.col("length").cast("int").alias("fill"), F.array(F.struct(
        "piece_id", F.col("length").cast("int").alias("length"))).alias("members"))
    closed: list[DataFrame] = []
    left, level = partial.count(), 0
    while True:
        tasks = max(1, -(-left // TASK_ITEMS))
        first = F.col("members")[0]["piece_id"]
        dealt = items.withColumn("id", first).withColumn("task", F.pmod(F.xxhash64(first, F.lit(level)), F.lit(tasks)))
        path = work_path(spark, f"bins{level}")
        dealt.groupBy("task").applyInArrow(lambda table: _pack(table, capacity), BIN).write.parquet(path)
        bins = spark.read.schema(BIN).parquet(path)
        full = F.col("fill") >= capacity - SLACK
        still = bins.where(~full).count() if tasks > 1 else 0
        if tasks == 1 or still > 0.99 * left:
            closed.append(bins)
            break
        closed.append(bins.where(full))
        items, left, level = bins.where(~full), still, level + 1

    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    ends = F.expr("transform(members, (m, i) -> aggregate(slice(members, 1, i), 0, (s, x) -> s + x.length))")
    small = bins.select(F.col("members")[0]["piece_id"].alias("sequence_id"), F.explode(F.arrays_zip(
        F.col("members.piece_id").alias("piece_id"), ends.alias("offset"))).alias("m")).select(
        "m.piece_id", "sequence_id", F.col("m.offset").cast("bigint").alias("offset"))
    return small


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, with whatever columns they carry, and their ``sequence_id`` and ``offset``."""
    spots = place(pieces, capacity)
    full = F.col("length") >= capacity
    # dealt by the key: Spark takes members before they are exploded for the size of the spots and would send all of them to every task
    settled = pieces.where(full).withColumns({"sequence_id": F.col("piece_id"), "offset": F.lit(0).cast("bigint")})
    return pieces.where(~full).join(spots.hint("merge"), "piece_id").select(*pieces.columns, "sequence_id", "offset").unionByName(settled)
