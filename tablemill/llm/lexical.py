"""Ranked lexical search by norm buckets.

A score is an inner product of a query's term weights and a document's impacts, all integers (see ``impact`` and
``weight``). Only terms of the queries matter, so a document is a sparse vector over these; both sides are scaled by the root
of the weight, so rare terms make a vector long and common ones hardly do.

1. One pass over the texts counts all terms of a document and its occurrences of query terms.
2. Documents are ordered by the length of their vectors and cut into buckets of similar length, each one row.
3. Buckets are searched longest first, in rounds that grow by ``GROWTH``. A query's k-th best score so far is its
   threshold, carried from round to round and within a task from bucket to bucket. By Cauchy-Schwarz a bucket is passed over
   where the lengths of the query and of the bucket's longest vector multiply to less than the threshold.
4. Inside a bucket a few coordinates of greatest weight are read first. What they give, plus the lengths of the remaining
   parts multiplied, bounds a score; documents below the threshold leave.
5. Survivors are scored exactly in 64-bit integers. A task returns at most k documents per query.

Bounds are compared with a relative slack of 1e-9, so rounding never loses a document. Queries are taken in blocks of about
``BLOCK_TERMS`` terms: only a block's terms, weights and thresholds are on the driver and in the tasks.

Defined results: null or blank texts have no terms, are counted nowhere and match nothing; a query without terms has no
rows; texts of any length are read whole; equal scores go by ascending document id, a null id last; rows repeated in full are
candidates each, and queries repeated in full are answered each; empty tables give an empty result; only ids and texts are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.llm.units import slices
from tablemill.session import work_path

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 200_000  # (query, term) pairs answered together
BUCKET, BUCKET_TERMS = 2048, 1 << 20  # documents of a bucket, and entries of their vectors
FIRST, GROWTH = 32, 16  # buckets of the first round, and how rounds grow
FOCUS = 6  # coordinates read before a document's bound is taken
SLACK = 1e-9

COUNTS = "doc_id bigint, n bigint, terms array<int>, times array<bigint>"
VECTORS = "doc_id bigint, norm double, terms array<int>, impacts array<bigint>"
BUCKETS = "longest double, ids array<bigint>, norms array<double>, ends array<int>, terms array<int>, impacts array<bigint>"
HITS = "query int, doc_id bigint, score bigint"


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def impact(times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``times`` in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _ends(lists: pa.ListArray) -> np.ndarray:
    return np.cumsum(lists.value_lengths().to_numpy())


def _counts(docs: DataFrame, vocabulary: list[str], text: str, key: str) -> DataFrame:
    """Number of all terms of a document, and how often it holds each term of the vocabulary (by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary, pa.string())
        for batch in slices(batches, 1, 4 << 20):
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            found = pc.split_pattern_regex(texts, BREAKS)
            owner, flat = pc.list_parent_indices(found).to_numpy(), found.flatten()
            n = np.bincount(owner, weights=pc.not_equal(flat, "").cast(pa.int8()).to_numpy(), minlength=len(texts))
            number = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy()
            known = number >= 0
            code, times = np.unique(owner[known].astype(np.int64) * len(vocabulary) + number[known], return_counts=True)
            row, term = np.divmod(code, len(vocabulary))
            sizes = np.bincount(row, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), _lists(term, sizes, pa.int32()), _lists(times, sizes, pa.int64())],
                names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, COUNTS)


def _vectors(counts: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """Documents with their impacts and the length of their scaled vector, where it is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            n = np.repeat(batch.column(1).to_numpy(), sizes)
            value = impact(batch.column(3).flatten().to_numpy(), n, documents, total)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            norm = np.sqrt(np.bincount(owner, weights=weights[terms] * value.astype(float) ** 2, minlength=batch.num_rows))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), batch.column(2), _lists(value, sizes, pa.int64())],
                names=["doc_id", "norm", "terms", "impacts"])
            yield out.filter(pa.array(norm > 0))

    return counts.mapInArrow(run, VECTORS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of length to buckets."""
    names = ["longest", "ids", "norms", "ends", "terms", "impacts"]

    def bucket(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, norms, terms, impacts = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
        one = [ids, norms, pa.array(_ends(terms).astype(np.int32)), terms.flatten(), impacts.flatten()]
        return pa.RecordBatch.from_arrays(
            [pa.array([pc.max(norms).as_py()], pa.float64())]
            + [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in one], names=names)

    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ends = _ends(batch.column(2).slice(at))
            fits = min(BUCKET - rows, int(np.searchsorted(ends, BUCKET_TERMS - entries, side="right")))
            if fits == 0 and not rows:
                fits = 1
            if fits:
                held.append(batch.slice(at, fits))
                took = min(fits, len(ends))
                rows, entries, at = rows + took, entries + int(ends[took - 1]), at + took
            if at < batch.num_rows:
                yield bucket(pa.Table.from_batches(held))
                held, rows, entries = [], 0, 0
    if rows:
        yield bucket(pa.Table.from_batches(held))


class _Bucket:
    """A bucket's vectors by document, and a term's documents and impacts."""

    def __init__(self, r: dict):
        self.none, self.ids = r["ids"].is_null().to_numpy(zero_copy_only=False), pc.fill_null(r["ids"], 0).to_numpy()
        self.norms, self.ends = r["norms"].to_numpy(), r["ends"].to_numpy()
        self.terms, self.impacts = r["terms"].to_numpy(), r["impacts"].to_numpy()
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        order = np.argsort(self.terms, kind="stable")
        self.sorted, self.holder, self.value = self.terms[order], owner[order], self.impacts[order]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.sorted, [term, term + 1])
        return self.holder[a:b], self.value[a:b]

    def survivors(self, terms: np.ndarray, weights: np.ndarray, threshold: int) -> np.ndarray:
        """Documents whose bound from the heaviest coordinates reaches the threshold."""
        given, used = np.zeros(len(self.norms)), np.zeros(len(self.norms))
        for term, w in zip(terms[:FOCUS], weights[:FOCUS]):
            holder, value = self.postings(term)
            given[holder] += w * value.astype(float)
            used[holder] += w * value.astype(float) ** 2
        rest = np.sqrt(weights[FOCUS:].sum()) * np.sqrt(np.maximum(self.norms**2 * (1 + SLACK) - used, 0))
        return np.flatnonzero((given + rest) * (1 + SLACK) >= max(threshold, 1))

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores under the weights by term number."""
        sizes = self.ends[docs] - self.starts[docs]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        spot = np.repeat(self.starts[docs] - first, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(dense[self.terms[spot]] * self.impacts[spot], first) if len(docs) else np.empty(0, np.int64)


def _searched(buckets: DataFrame, queries: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [math.sqrt(weights[t].sum()) for t in queries]
        floor, dense = thresholds.copy(), np.zeros(len(weights), np.int64)
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                bucket = None
                longest = batch.column(0)[row].as_py()
                for q, terms in enumerate(queries):
                    if lengths[q] * longest * (1 + SLACK) < max(floor[q], 1):
                        continue
                    if bucket is None:
                        bucket = _Bucket({n: batch.column(i)[row].values for i, n in enumerate(batch.schema.names) if i})
                    docs = bucket.survivors(terms, weights[terms], floor[q])
                    dense[terms] = weights[terms]
                    score = bucket.scores(docs, dense)
                    dense[terms] = 0
                    good = score >= max(floor[q], 1)
                    if not good.any():
                        continue
                    found = [bucket.none[docs[good]], bucket.ids[docs[good]], score[good]]
                    if q in best:
                        found = [np.concatenate(pair) for pair in zip(best[q], found)]
                    none, ids, score = found
                    order = np.lexsort((ids, none, -score))[:k]
                    best[q] = [column[order] for column in found]
                    if len(order) == k:
                        floor[q] = max(floor[q], score[order[-1]])
        for q, (none, ids, score) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, pa.int64(), mask=none), pa.array(score)],
                names=["query", "doc_id", "score"])

    return buckets.mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer(spark: SparkSession, docs: DataFrame, items: list, k: int, text: str, key: str) -> DataFrame:
    """Hits of one block of queries, given as ``(item_id, terms)``."""
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = _saved(_counts(docs, vocabulary, text, key), "counts")
    documents, total = counts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    holders = np.zeros(len(vocabulary), np.int64)
    for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        holders[term] = n  # at most one row per term of the block
    weights = np.array([weight(documents, int(h)) for h in holders], np.int64)

    vectors = _vectors(counts, weights, documents, total or 1)
    place = F.xxhash64("doc_id")
    parts = max(1, spark.sparkContext.defaultParallelism, -(-documents // (8 * BUCKET)))
    ordered = vectors.repartitionByRange(parts, F.desc("norm"), place).sortWithinPartitions(F.desc("norm"))
    buckets = _saved(ordered.mapInArrow(_pack, BUCKETS), "buckets")

    # the heaviest terms first
    queries = [np.array(sorted((number[t] for t in terms), key=lambda i: (-weights[i], i)), np.int64) for _, terms in items]
    count, marks, size = buckets.count(), [], FIRST
    while size < count:
        marks.append(1 - size / count)
        size *= GROWTH
    edges = buckets.agg(F.percentile_approx("longest", marks, 10_000)).first()[0] if marks else []
    thresholds, best, high = np.zeros(len(queries), np.int64), None, None
    for low in [*edges, None]:
        mine = buckets
        if high is not None:
            mine = mine.where(F.col("longest") <= high)
        if low is not None:
            mine = mine.where(F.col("longest") > low)
        hits = _searched(mine, queries, weights, thresholds, k)
        best = _saved(_ranked(hits if best is None else hits.unionByName(best), k).select("query", "doc_id", "score"), "hits")
        if low is not None:
            for q, score in best.groupBy("query").agg(F.min("score"), F.count(F.lit(1)).alias("n")).where(
                    F.col("n") == k).select("query", "min(score)").collect():  # one row per query of the block
                thresholds[q] = score
        high = low
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], "query int, item_id bigint")
    return _ranked(best, k).join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 for every item."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    terms = F.array_distinct(F.filter(F.split(F.translate(F.col(item_text), UPPER, LOWER), BREAKS), lambda t: t != ""))
    asked = _saved(items.select(F.col(item_key).cast("bigint").alias("item_id"), terms.alias("terms")).where(
        F.size("terms") > 0).withColumn("n", F.monotonically_increasing_id()), "items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        # about BLOCK_TERMS pairs reach the driver
        mine = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block).select("item_id", "terms").collect()
        if mine:
            out = out.unionByName(_answer(spark, docs, mine, k, text, key))
    return out
