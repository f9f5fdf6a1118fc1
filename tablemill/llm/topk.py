"""Exact top-k search by inner product: three-phase uniform threshold.

Vectors are quantised, dealt into blocks of about ``BLOCK`` rows and stored by dimension, so that a range of dimensions (a
slice) is one range of bytes. Each slice is a list holder that knows only its part of every score.

1. Every slice of every block gives its ``k`` best partial scores for each query. The candidates named so are scored
   exactly; the k-th best total ``t`` is a safe cutoff, as at least k rows reach it.
2. The cutoff travels with the query block to every slice. A total of ``t`` over ``m`` slices needs a part of at least
   ``t / m`` in one of them, so each slice gives all entries from there on: sufficient, whatever the signs.
3. The union of these entries is scored exactly; local lists of ``k`` meet in one ranking per query.

Query blocks meet vector blocks as pairs of block ids; work and traffic are spread over the pairs. Nothing is broadcast
or collected. Scores are exact in 64-bit floating point while the largest possible one stays below 2^53 (checked per
pair of blocks), and are computed as integers beyond; a score beyond 64 bits is an error.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an
id; vectors of different length never meet; equal scores go by smaller id; rows repeated in full are candidates each; a
query with fewer than k candidates gets them all; an empty table gives an empty result; only the id and vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import work_path

BLOCK = 1024
SLICES = 2

PACKED = "dim int, block int, ids binary, rows binary, data binary, peak double"
ENTRY = "dim int, qblock int, block int, codes array<int>"
HIT = "qrow bigint, query_id bigint, dim int, qblock int, qi int, block int, vi int, vec_id bigint, score bigint"


def quantise(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _pack(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("n")
    dim = table.column("dim")[0].as_py()
    flat = table.column("v").combine_chunks()
    flat = flat.flatten().to_numpy()
    data = np.ascontiguousarray(flat.reshape(-1, dim).T)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
        "ids": [table.column("id").to_numpy().astype("<i8").tobytes()],
        "rows": [table.column("n").to_numpy().astype("<i8").tobytes()],
        "data": [data.astype("<i8").tobytes()], "peak": [float(np.abs(data.astype(float)).max())]})


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` rows: ids, row numbers, and the components by dimension."""
    tasks = max(1, -(-rows.count() // BLOCK))
    path = work_path(rows.sparkSession, "blocks")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(tasks)).cast("int"))
    dealt.groupBy("dim", "block").applyInArrow(_pack, PACKED).write.parquet(path)
    return rows.sparkSession.read.schema(PACKED).parquet(path)


def _slices(blocks: DataFrame, count: int, prefix: str) -> DataFrame:
    """One row per block and slice with the bytes of its dimensions only."""
    b = F.col("slice")
    low, high = F.floor(F.col("dim") * b / count), F.floor(F.col("dim") * (b + 1) / count)
    wide = F.octet_length("ids")
    part = F.substring(F.col("data"), (low * wide + 1).cast("int"), ((high - low) * wide).cast("int"))
    return blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        "dim", F.col("block").alias(f"{prefix}block"), "slice", part.alias(f"{prefix}data"),
        *[F.col(c).alias(f"{prefix}{c}") for c in blocks.columns if c not in ("dim", "block", "data")])


def _scores(q: bytes, v: bytes, nq: int, nv: int, bound: float) -> np.ndarray:
    left, right = np.frombuffer(q, "<i8").reshape(-1, nq).T, np.frombuffer(v, "<i8").reshape(-1, nv)
    if bound * left.shape[1] < 2**53:
        return left.astype(float) @ right.astype(float)
    if bound * left.shape[1] >= 2**63:
        raise OverflowError("SCORE_OUT_OF_RANGE: the inner product does not fit 64 bits.")
    return left @ right


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of scores its ``k`` highest, all ties of the k-th included."""
    for i, row in enumerate(scores):
        if len(row) > k:
            yield i, np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        else:
            yield i, np.arange(len(row))


def _top_lists(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qrows, vrows = _ints(r["qrows"]), _ints(r["vrows"])
                s = _scores(r["qdata"], r["vdata"], len(qrows), len(vrows), r["qpeak"] * r["vpeak"]).astype(float)
                own = qrows[:, None] == vrows[None, :]
                s[own] = -np.inf
                vids, out = _ints(r["vids"]), [[], [], [], []]
                for i, best in _best(s, vids, k):
                    # ties beyond k change no k-th score
                    best = best[np.lexsort((vids[best], -s[i, best]))][:k]
                    best = best[s[i, best] > -np.inf]
                    for column, value in zip(out, (np.full(len(best), qrows[i]), np.full(len(best), i), best, s[i, best])):
                        column.append(value)
                qn, qi, vi, score = map(np.concatenate, out)
                n = len(qn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qn), pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["qblock"], np.int32)),
                     pa.array(qi.astype(np.int32)), pa.array(np.full(n, r["vblock"], np.int32)), pa.array(vi.astype(np.int32)),
                     pa.array(np.full(n, r["slice"], np.int32)), pa.array(score.astype(float))],
                    names=["qrow", "dim", "qblock", "qi", "block", "vi", "slice", "part"])
    return run


def _sufficient(slices: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qrows, vrows = _ints(r["qrows"]), _ints(r["vrows"])
                s = _scores(r["qdata"], r["vdata"], len(qrows), len(vrows), r["qpeak"] * r["vpeak"]).astype(float)
                cut = np.full(len(qrows), -np.inf)
                for c in r["cutoffs"] or []:
                    cut[c["qi"]] = c["cutoff"]
                # a hair below, so that rounding of very large scores cannot lose an entry
                with np.errstate(invalid="ignore"):
                    enough = s * slices >= (cut - np.abs(cut) * 1e-12)[:, None]
                enough[qrows[:, None] == vrows[None, :]] = False
                qi, vi = np.nonzero(enough)
                yield pa.RecordBatch.from_pylist(
                    [{"dim": r["dim"], "qblock": r["qblock"], "block": r["vblock"], "codes": (qi * len(vrows) + vi).tolist()}],
                    schema=pa.schema([("dim", pa.int32()), ("qblock", pa.int32()), ("block", pa.int32()),
                                      ("codes", pa.list_(pa.int32()))]))
    return run


def _resolve(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                codes = r.pop("codes").values.to_numpy()
                r = {name: value.as_py() for name, value in r.items()}
                qrows, qids, vids = _ints(r["qrows"]), _ints(r["qids"]), _ints(r["vids"])
                qi, vi = np.divmod(codes, len(vids))
                bound = r["qpeak"] * r["vpeak"] * r["dim"]
                if bound >= 2**63:
                    raise OverflowError("SCORE_OUT_OF_RANGE: the inner product does not fit 64 bits.")
                q = _ints(r["qdata"]).reshape(-1, len(qids)).T
                v = _ints(r["vdata"]).reshape(-1, len(vids)).T
                score = np.concatenate([np.einsum("ij,ij->i", q[qi[a:a + 65536]], v[vi[a:a + 65536]])
                                        for a in range(0, len(qi), 65536)] or [np.empty(0, np.int64)])
                order = np.lexsort((vids[vi], -score, qi))
                qi, vi, score = qi[order], vi[order], score[order]
                first = np.searchsorted(qi, qi)
                keep = np.arange(len(qi)) - first < k
                qi, vi, score = qi[keep], vi[keep], score[keep]
                n = len(qi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qrows[qi]), pa.array(qids[qi]), pa.array(np.full(n, r["dim"], np.int32)),
                     pa.array(np.full(n, r["qblock"], np.int32)), pa.array(qi.astype(np.int32)),
                     pa.array(np.full(n, r["vblock"], np.int32)), pa.array(vi.astype(np.int32)), pa.array(vids[vi]),
                     pa.array(score.astype(np.int64))],
                    names=["qrow", "query_id", "dim", "qblock", "qi", "block", "vi", "vec_id", "score"])
    return run


def search(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           scale: int = 1024, slices: int = SLICES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for every row where ``is_query`` holds."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    path = work_path(spark, "vectors")
    # written once, so that row numbers stay
    (df.where(usable(F.col(vector)) & F.col(key).isNotNull())
     .select(F.monotonically_increasing_id().alias("n"), F.col(key).cast("bigint").alias("id"), quantise(F.col(vector), scale).alias("v"),
             F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("query")).write.parquet(path))
    rows = spark.read.parquet(path)
    queries = _blocks(rows.where("query").drop("query"))
    vectors = _blocks(rows.drop("query"))

    pairs = queries.select("dim", F.col("block").alias("qblock")).join(vectors.select("dim", F.col("block").alias("vblock")), "dim")
    qs, vs = _slices(queries, slices, "q"), _slices(vectors, slices, "v")
    lists = pairs.join(qs, ["dim", "qblock"]).join(vs, ["dim", "vblock", "slice"]).mapInArrow(
        _top_lists(k), "qrow bigint, dim int, qblock int, qi int, block int, vi int, slice int, part double")
    place = F.row_number().over(Window.partitionBy("qrow", "slice").orderBy(F.desc("part"), "block", "vi"))
    named = lists.withColumn("place", place).where(F.col("place") <= k)

    whole_q = queries.withColumnsRenamed({c: f"q{c}" for c in ("block", "ids", "rows", "data", "peak")})
    whole_v = vectors.withColumnsRenamed({c: f"v{c}" for c in ("block", "ids", "rows", "data", "peak")})

    def resolve(wanted: DataFrame) -> DataFrame:
        return (wanted.withColumnRenamed("block", "vblock").join(whole_q, ["dim", "qblock"]).join(whole_v, ["dim", "vblock"])
                .mapInArrow(_resolve(k), HIT))

    # (query, row) as one number within a pair of blocks
    size = vectors.select("dim", F.col("block"), (F.octet_length("ids") / 8).cast("int").alias("size"))
    first = named.join(size, ["dim", "block"]).groupBy("dim", "qblock", "block").agg(
        F.collect_set((F.col("qi") * F.col("size") + F.col("vi")).cast("int")).alias("codes"))
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    cutoff = resolve(first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    cutoffs = cutoff.groupBy("dim", "qblock").agg(
        F.collect_list(F.struct("qi", F.col("score").cast("double").alias("cutoff"))).alias("cutoffs"))

    entries = pairs.join(qs.join(cutoffs, ["dim", "qblock"], "left"), ["dim", "qblock"]).join(
        vs, ["dim", "vblock", "slice"]).mapInArrow(_sufficient(slices), ENTRY)
    wanted = entries.groupBy("dim", "qblock", "block").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    return resolve(wanted).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
