"""Near-dedup: SuperMinHash signatures, banding, verification on full sets, union of links.

1. ``signatures``: every text becomes its shingle set (see ``shingles``), a SuperMinHash signature, and band keys.
   Texts with the same set are one class with a number of its own; only classes go on.
2. Banding: classes that share a band key are a bucket. Each is verified against the most central of its bucket, the one
   that meets most others in all its buckets (a star, never all pairs), on full sets, and verified links are united. Variants
   of one text, of which most are far from each other, are nearest to that text, so they become one group at a cost in
   proportion to their number. Buckets that still hold several groups take another star, around another class.
3. A bucket may still hold several groups. For all classes of such buckets an exact search follows, across groups only:
   two sets with similarity ``t`` share an element among the first ``n - ceil(t n) + 1`` of each, elements ordered by how
   many sets hold them. Rare elements come first, so variants of one popular text, whose differences fill that prefix,
   meet only where they are similar enough; sizes and positions bound the overlap before anything is emitted. Found pairs
   are verified and united. There is no cap on buckets, partners or candidates.

With 120 slots in bands of 5, two texts at similarity 0.85 share no bucket with probability 8e-7.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; fewer than five words are one
element; a null id takes no part and is its own (null) component; a component is named by its smallest id, and the rows with
that id are kept in ``near_groups``; ``keep_one`` leaves those of one text alone; rows repeated in full share their fate; rows
that share an id and not a text are told apart; an empty table gives an empty result; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm import superminhash
from tablemill.llm.shingles import mix, shingle_sets
from tablemill.llm.units import slices
from tablemill.session import work_path

SLOTS = 120
STARS = 2


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both by the key: Spark sizes exploded bands, pruned columns and packed files far
    too low, and what it takes for small goes through the driver's memory to every task."""
    return df.hint("merge")


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _mark(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(df: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 5) -> DataFrame:
    """``doc_id, mark, n_shingles, digest, bands``; the bands of an empty set are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(_bytes(batch.column(1)))
            drawn = superminhash.signatures(sets, SLOTS)
            with np.errstate(over="ignore"):
                bands = np.repeat(np.arange(SLOTS // rows, dtype=np.uint64)[None, :], len(sets), axis=0)
                for k in range(rows):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k::rows][:, :SLOTS // rows])
            filled = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.concatenate([[0], np.cumsum(filled * (SLOTS // rows))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[filled].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary()), lists],
                names=["doc_id", "mark", "n_shingles", "digest", "bands"])

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _mark(F.col(text)).alias("mark")).mapInArrow(
        run, "doc_id bigint, mark binary, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(df: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """``node, elements``: the set of each wanted class, from the text that gave it its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 2 << 20):
            sets = shingle_sets(_bytes(batch.column(2)))
            right = [k for k, (s, d) in enumerate(zip(sets, batch.column(1).to_pylist())) if _digest(s) == d]
            held = [sets[k] for k in right]
            flat = np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), lists],
                                             names=["node", "elements"])

    texts = df.select(F.struct(F.col(key).cast("bigint").alias("doc_id"), _mark(F.col(text)).alias("mark")).alias("name"),
                      F.col(text).alias("text"))
    return _dealt(wanted).join(texts, "name").select("node", "digest", "text").mapInArrow(
        run, "node bigint, elements array<bigint>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(_dealt(left), "a").join(_dealt(right), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node of the links.

    Labels spread to neighbours and then jump along themselves, so the number of rounds grows with the logarithm of the
    longest path; each round is written, and reads only what the last one wrote.
    """
    both = _saved(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = _saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(_dealt(labels.withColumnsRenamed({"node": "other", "label": "next"})), "other").groupBy("node").agg(
            F.min("next").alias("next"))
        spread = labels.join(_dealt(near), "node").select("node", "label", F.least("label", "next").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = _saved(spread.join(_dealt(jump), "next").select("node", F.col("label").alias("old"),
                                                      F.least("next", "far").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _relabelled(df: DataFrame, merged: DataFrame) -> DataFrame:
    """``df`` with the groups that ``merged (label, new)`` unites under one label."""
    return df.join(_dealt(merged), "label", "left").withColumn("label", F.coalesce("new", "label")).select(*df.columns)


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of ``members (bucket, node, label)`` whose bucket holds several groups."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(_dealt(mixed.select("bucket")), "bucket", "left_semi")


def _spokes(members: DataFrame, turn: int) -> DataFrame:
    """``a, b, label_a, label_b``: in every bucket one class, the most central or a random one, and those of other groups."""
    draw = F.xxhash64("node", F.lit(turn)) if turn else -F.col("centre")
    drawn = F.struct(draw.alias("draw"), F.col("node").alias("node"), F.col("label").alias("label"))
    hubs = members.groupBy("bucket").agg(F.min(drawn).alias("hub"))
    pairs = members.join(_dealt(hubs), "bucket").where(F.col("label") != F.col("hub.label"))
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.label").alias("label_a"),
                        F.col("label").alias("label_b")).distinct()


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups among ``open_ (node, label)`` that may be similar enough; none that is gets lost."""
    elements = open_.join(_dealt(sets), "node").select("node", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    shared = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # ceil(percent n / 100) of a set's elements must be in the other one
    reach = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    held = elements.join(_dealt(shared), "e")
    later = held.groupBy("node").agg((F.max("n") - F.count(F.lit(1))).alias("alone"), F.max("n").alias("m")).withColumn(
        "reach", F.expr(f"m - (m * {percent} + 99) div 100 + 1")).where("alone < reach").select("node", "alone")
    order = Window.partitionBy("node").orderBy("df", "e")
    placed = held.join(_dealt(later), "node").withColumn("at", F.col("alone") + F.row_number().over(order) - 1).where(
        F.col("at") < reach).join(_dealt(open_), "node").select("e", "node", "label", "n", "at")
    placed = _saved(placed, "prefixes")
    mixed = placed.groupBy("e").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("e")
    placed = placed.join(_dealt(mixed), "e")
    left = placed.select("e", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "at")])
    right = placed.select("e", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "at")])
    most = "(1 + least(n_a - at_a - 1, n_b - at_b - 1))"
    fits = F.expr(f"label_a < label_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) "
                  f"AND 100 * {most} >= {percent} * (n_a + n_b - {most})")
    return left.join(_dealt(right), (left["e"] == right["e"]) & fits).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_groups(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id", rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; linked at a Jaccard similarity of ``percent`` or more."""
    return _groups(df, percent, text, key, rows).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(df: DataFrame, percent: int, text: str, key: str, rows: int = 4) -> DataFrame:
    """``near_groups`` with the ``name`` of every row, its id and the mark of its text."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    drawn = _saved(signatures(df, text, key, rows), "signatures")
    classes = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "mark")).alias("name"), F.first("bands").alias("bands"))
    # an id may stand for several texts, so it cannot be the node; the numbers are settled by being written
    classes = _saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keyed.join(_dealt(buckets), "bucket")
    nodes = met.groupBy("node").agg(F.sum("size").alias("centre"))
    members = _saved(met.join(_dealt(nodes), "node").select("bucket", "node", "centre", F.col("node").alias("label")), "members")
    nodes = members.select("node").distinct()
    wanted = nodes.join(_dealt(classes.select("node", "digest", "name")), "node")
    sets = _saved(_sets(df, wanted, text, key), "sets")
    first, open_ = nodes.withColumn("label", F.col("node")), members
    for turn in range(STARS):
        spokes = _saved(_spokes(open_, turn), "spokes")
        links = _verified(spokes.select("a", "b"), sets, percent).join(_dealt(spokes), ["a", "b"]).select(
            F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        links = _saved(links.distinct(), "stars")
        if links.isEmpty():
            break
        merged = components(links).select(F.col("node").alias("label"), F.col("label").alias("new"))
        first = _saved(_relabelled(first, merged), "groups")
        open_ = _saved(_mixed(_relabelled(open_, merged)), "open")

    # classes of buckets that still hold several groups
    open_ = _saved(_mixed(open_).select("node", "label").distinct(), "open")
    more = _verified(_prefix_pairs(open_, sets, percent), sets, percent)
    labelled = open_
    merged = components(more.join(_dealt(labelled.withColumnsRenamed({"node": "a", "label": "la"})), "a").join(
        _dealt(labelled.withColumnsRenamed({"node": "b", "label": "lb"})), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))

    placed = classes.select("digest", "node", "name").join(_dealt(first), "node", "left").select(
        "digest", "name", F.coalesce("label", "node").alias("node")).join(_dealt(merged), "node", "left").select(
        "digest", "name", F.coalesce("label", "node").alias("label"))
    placed = _saved(placed, "placed")
    final = placed.join(_dealt(placed.groupBy("label").agg(F.min("name").alias("winner"))), "label").select("digest", "winner")
    named = drawn.withColumn("name", F.struct("doc_id", "mark"))
    linked = named.where("n_shingles > 0 AND doc_id IS NOT NULL").join(_dealt(final), "digest").select(
        "doc_id", "n_shingles", F.col("winner.doc_id").alias("component_id"), (F.col("name") == F.col("winner")).alias("kept"), "name")
    alone = named.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "name")
    return linked.unionByName(alone)


def keep_one(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, one document per group, with all their columns."""
    dropped = _groups(df, percent, text, key).where(~F.col("kept")).select(F.col("name").alias("__gone")).distinct()
    name = F.struct(F.col(key).cast("bigint").alias("doc_id"), _mark(F.col(text)).alias("mark"))
    return df.join(dropped, name == F.col("__gone"), "left_anti")
