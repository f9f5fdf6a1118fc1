"""Substring dedup by suffix automata of reference shards.

A window is ``window`` consecutive words of a document. A word goes when a window that covers it also starts in a document
with a smaller id; so the first document with a passage keeps it, and maximal repeated spans go from the others.

1. Every window has an anchor, the run of ``window // 6`` words in it with the least hash, so equal windows have equal
   anchors. Anchors that occur in one document only end here, which is nearly all of ordinary prose.
2. Windows in a row with one anchor are a segment, a bounded piece of text. Equal segments are taken together with their
   least and greatest document before anything else is done with them.
3. An anchor at the border of a popular passage meets as many different segments as documents. Where an anchor has more
   than ``MANY``, its segments are first trimmed to windows that more than one document holds, counted by an ordinary
   aggregate; what is left are parts of the passage, few of them different.
4. The different segments are the reference, but for those that no later document can hold. They are dealt by anchor into
   shards of about ``SHARD_WORDS``; a shard is a suffix automaton whose states know the least document of their strings.
5. Automata travel as the words they are made of, a tenth of their size, and are built where they are used. They are broadcast
   where all of them together stay within ``BROADCAST_BYTES``. Beyond that each goes only to the tasks that stream segments
   of its anchors, in blocks of ``BLOCK``, so a shard in great demand is read by many tasks.
6. Streaming gives the matching statistics and with them the least document of every window of a segment. Documents look up
   their segments, and the covered words go.

Words are compared by 64-bit hashes. Defined results: null, empty and short texts lose nothing; texts of any length are read
whole; a passage twice in one document stays; a null id loses nothing and takes nothing from others; rows that share an id
take nothing from each other, and each keeps its own text; rows repeated in full share their fate; an empty table gives an
empty result; ``drop_repeats`` passes other columns through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.automaton import NEVER, Automaton, Builder
from tablemill.llm.shingles import mix, text_slices, word_spans
from tablemill.llm.units import slices
from tablemill.session import work_path

WINDOW = 50
MANY = 500  # different segments of one anchor, beyond which they are trimmed first
SHARD_WORDS = 50_000
BLOCK = 1000  # segments streamed through an automaton together
BROADCAST_BYTES = 32 << 20
RUN = 4096  # words written at once
_STEP = np.uint64(0xD6E8FEB86659FD93)

DRAWN = "doc_id bigint, mark binary, n_words bigint, kept_sha256 string, anchors array<bigint>"
SEGMENTS = "doc_id bigint, mark binary, start int, anchor bigint, digest binary, content binary"
LEAST = "digest binary, start int, windows int, low bigint"


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _named(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("doc_id"), _mark(F.col(text)).alias("mark"),
                     F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    with np.errstate(over="ignore"):
        count = max(0, len(words) - width + 1)
        value = words[:count]
        for k in range(1, width):
            value = value * _STEP + words[k:count + k]
        return mix(value)


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window: the least hash among its short runs."""
    if len(words) < window:
        return words[:0]
    width = max(1, window // 6)
    value, span, wanted = _runs_of(words, width), 1, window - width + 1
    while span < wanted:
        step = min(span, wanted - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    return value


def _segments(anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of windows with one anchor; of a very long run bounded parts."""
    edge = np.flatnonzero(np.diff(anchors)) + 1
    first, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(anchors)]])
    parts = -(-(end - first) // window)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + nth * window
    return start, np.minimum(start + window, np.repeat(end, parts))


def _normal(data: bytes) -> bytes:
    return b" ".join(data.split())


def _sha256(data: bytes) -> str:
    """Of all words joined by one blank."""
    out, any_words = hashlib.sha256(), False
    for part in text_slices(data):
        words = _normal(part)
        if words:
            out.update(b" " + words if any_words else words)
            any_words = True
    return out.hexdigest()


def _draw(named: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            n, sha, anchors = [], [], []
            for text in batch.column(2).to_pylist():
                words = word_spans(text)[0]
                n.append(len(words))
                sha.append(_sha256(text))
                anchors.append(np.unique(_anchors(words, window)).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, anchors)]), pa.int32()),
                                             pa.array(np.concatenate([*anchors, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), lists],
                                             names=["doc_id", "mark", "n_words", "kept_sha256", "anchors"])

    return named.mapInArrow(run, DRAWN)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """The segments of ``texts (doc_id, mark, text, shared)`` whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                words, begin, end = word_spans(text)
                anchors = _anchors(words, window)
                first, last = _segments(anchors, window)
                wanted = np.isin(anchors[first].view(np.int64), batch.column(3)[i].values.to_numpy())
                for a, b in zip(first[wanted].tolist(), last[wanted].tolist()):
                    content = _normal(text[begin[a]:end[b + window - 2]])
                    row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), a, int(anchors[a].view(np.int64)),
                           hashlib.blake2b(content, digest_size=16).digest(), content)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["doc_id", "mark", "start", "anchor", "digest", "content"])

    return texts.select("doc_id", "mark", "text", "shared").mapInArrow(run, SEGMENTS)


def _trimmed(contents: DataFrame, window: int) -> DataFrame:
    """``anchor, low, content``: the parts of the contents whose windows more than one document holds."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 1 << 20):
            runs = [_runs_of(words, window).view(np.int64) for words in _words_of(batch.column(3).to_pylist())]
            owner = pa.array(np.repeat(np.arange(len(runs)), list(map(len, runs))))
            at = pa.array(np.concatenate([np.arange(len(r), dtype=np.int32) for r in runs] or [np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(owner) for c in range(3)), at, pa.array(np.concatenate([*runs, np.empty(0, np.int64)]))],
                names=["digest", "low", "high", "at", "run"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            out: list[list] = [[], [], []]
            for anchor, low, content, spots in zip(*(c.to_pylist() for c in batch.columns)):
                words, spots = content.split(), np.sort(spots)
                for held in np.split(spots, np.flatnonzero(np.diff(spots) > 1) + 1):
                    for column, value in zip(out, (anchor, low, b" ".join(words[held[0]:held[-1] + window]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))],
                                             names=["anchor", "low", "content"])

    rows = _saved(contents.select("digest", "low", "high", "content").mapInArrow(
        windows, "digest binary, low bigint, high bigint, at int, run bigint"), "windows")
    again = rows.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("run")
    spots = rows.join(again, "run", "left_semi").groupBy("digest").agg(F.collect_set("at").alias("spots"))
    return contents.join(spots, "digest").select("anchor", "low", "content", "spots").mapInArrow(
        parts, "anchor bigint, low bigint, content binary")


def _words_of(contents: list[bytes]) -> list[np.ndarray]:
    """The hashed words of every content, hashed together."""
    words, begin, _ = word_spans(b" ".join(contents))
    return np.split(words, np.searchsorted(begin, np.cumsum([len(c) + 1 for c in contents])[:-1])) if contents else []


def _built(reference: pa.StructArray) -> Automaton:
    builder = Builder()
    for low, words in zip(reference.field("low").to_pylist(), _words_of(reference.field("content").to_pylist())):
        builder.add(words.tolist(), low)
    return Automaton(builder)


def _streamed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                held, known = batch.column(1)[row].values, batch.column(2)[row].values
                digest, high, content = (held.field(f).to_pylist() for f in ("digest", "high", "content"))
                if shard != batch.column(0)[row].as_py():
                    shard, automaton = batch.column(0)[row].as_py(), _built(known)
                words = _words_of(content)
                sizes = np.array(list(map(len, words)))
                table = np.zeros((len(words), sizes.max()), np.uint64)
                for line, w in zip(table, words):
                    line[:len(w)] = w
                low = automaton.least(table, sizes, window)
                # windows in a row with one answer are one row; those that help no document are none
                low[low >= np.array(high)[:, None]] = NEVER
                new = np.ones(low.shape, bool)
                new[:, 1:] = low[:, 1:] != low[:, :-1]
                owner, first = np.nonzero(new)
                end = np.append(first[1:], 0)
                end[end == 0] = low.shape[1]
                value = low[owner, first]
                useful = value < NEVER
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()).take(pa.array(owner[useful])), pa.array(first[useful].astype(np.int32)),
                     pa.array((end - first)[useful].astype(np.int32)), pa.array(value[useful])],
                    names=["digest", "start", "windows", "low"])
    return run


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")


def _least(contents: DataFrame, window: int) -> DataFrame:
    """The least document of the windows of the different segments, where one of their documents is greater."""
    anchors = contents.groupBy("anchor").agg(
        F.min("low").alias("first"), F.max("high").alias("last"), F.count(F.lit(1)).alias("n"))
    contents = _saved(contents.join(anchors, "anchor"), "compared")
    # what no later document can hold is no reference, and what no earlier one can hold is not looked up
    useful = contents.where("low < last")
    few = useful.where(F.col("n") <= MANY).select("anchor", "low", "content")
    trimmed = _trimmed(contents.where(F.col("n") > MANY), window)
    reference = _saved(few.unionByName(trimmed.groupBy("anchor", "content").agg(F.min("low").alias("low")).select(*few.columns)),
                       "reference")
    size, words = reference.agg(F.sum(F.octet_length("content")), F.sum(F.octet_length("content") - F.octet_length(
        F.translate(F.col("content").cast("string"), " ", "")) + 1)).first()
    shards = max(1, -(-(words or 0) // SHARD_WORDS))
    known = reference.groupBy(_shard(shards)).agg(F.collect_list(F.struct("low", "content")).alias("reference"))
    known = F.broadcast(known) if (size or 0) <= BROADCAST_BYTES else known

    streams = contents.where("first < high").select(_shard(shards), "digest", "high", "content")
    blocks = streams.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = streams.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks"))).groupBy(
        "shard", "block").agg(F.collect_list(F.struct("digest", "high", "content")).alias("segments"))
    return dealt.join(known, "shard").select("shard", "segments", "reference").mapInArrow(_streamed(window), LEAST)


def _edited(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark, n_removed, kept`` for ``texts (doc_id, mark, text, spans)``; a span is its first word and its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            removed, kept = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3)):
                _, begin, end = word_spans(text)
                steps = np.zeros(len(begin) + 1, np.int64)
                a, b = (spans.values.field(f).to_numpy() for f in ("a", "b"))
                np.add.at(steps, a, 1)
                np.add.at(steps, b, -1)
                left = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(left) > 1) + 1, [len(left)]])
                parts = [_normal(text[begin[left[i]]:end[left[min(i + RUN, z) - 1]]])
                         for y, z in zip(cuts[:-1], cuts[1:]) for i in range(y, z, RUN)]
                removed.append(len(begin) - len(left))
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "mark", "n_removed", "kept"])

    return texts.select("doc_id", "mark", "text", "spans").mapInArrow(
        run, "doc_id bigint, mark binary, n_removed bigint, kept binary")


def _repeats(named: DataFrame, drawn: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark, n_removed, kept`` of the documents that lose words."""
    name = ["doc_id", "mark"]
    anchors = drawn.where("doc_id IS NOT NULL").select(*name, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(
        "low < high").select("anchor")
    wanted = anchors.join(shared, "anchor", "left_semi").groupBy(*name).agg(F.collect_set("anchor").alias("shared"))
    texts = _saved(named.join(wanted, name), "texts")
    segments = _saved(_cut(texts, window), "segments")
    contents = _saved(segments.groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("anchor").alias("anchor"),
        F.first("content").alias("content")), "contents")

    least = _saved(_least(contents, window), "least").withColumnRenamed("start", "from")
    spans = segments.select(*name, "start", "digest").join(least, "digest").where("low < doc_id").groupBy(*name).agg(
        F.collect_set(F.struct((F.col("start") + F.col("from")).alias("a"),
                               (F.col("start") + F.col("from") + F.col("windows") + window - 1).alias("b"))).alias("spans"))
    return _edited(texts.join(spans, name), window)


def decide(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row; the digest is of the kept words joined by one blank."""
    named = _named(df, text, key)
    drawn = _saved(_draw(named, window), "drawn")
    edits = _repeats(named, drawn, window).groupBy("doc_id", "mark").agg(
        F.max("n_removed").alias("n_removed"), F.max(F.sha2("kept", 256)).alias("sha"))
    return drawn.join(edits, ["doc_id", "mark"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def drop_repeats(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the repeated words taken out; a text that loses some has its other words joined by one blank."""
    named = _named(df, text, key)
    drawn = _saved(_draw(named, window), "drawn")
    edits = _repeats(named, drawn, window).dropDuplicates(["doc_id", "mark"]).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("kept").cast("string").alias("__kept"))
    joined = df.join(edits, (F.col(key).cast("bigint") == F.col("__id")) & (_mark(F.col(text)) == F.col("__mark")), "left")
    return joined.select(*[F.coalesce("__kept", text).alias(c) if c == text else F.col(c) for c in df.columns])
