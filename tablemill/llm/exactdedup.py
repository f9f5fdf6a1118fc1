"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after deleting ASCII white space. Rows become small fingerprints (SHA-256 of the
normalised text, length, id), written once. A frequent-items sketch (the mergeable Misra-Gries summary behind
``approx_top_k``) names the digests that may be frequent; an exact count over those alone verifies them. Verified winners
are at most ``HEAVY`` rows, are broadcast, and settle their copies on the map side, so a group that holds a third of all
rows is never shuffled. All other digests are grouped by an ordinary shuffle.

Defined results: null text counts as empty; empty texts form one group; of equal texts the row with the most code points
stays, then the smallest id (a null id comes last); rows repeated in full are copies, each is returned, and all of them
name the same id; an empty table gives an empty result; other columns, whatever their names, pass through ``keep_first``,
which leaves exactly one row per digest: null or repeated ids do not touch rows with other texts, and of rows that tie in
digest, length and id any one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.tables import once
from tablemill.session import work_path

SPACE = r"[\x20\x09-\x0D]+"
# Candidates that the sketch returns and counters that it holds: both bound what is broadcast, neither changes a result.
HEAVY = 512
COUNTERS = 65_536
BITS = 1 << 27  # of the bitmap that tells which digests may occur twice: 16 MiB


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _thin(df: DataFrame, text: str, key: str) -> DataFrame:
    rows = df.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("digest"),
                     F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_chars"))
    path = work_path(df.sparkSession, "digests")
    rows.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays and the size of the group."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), "group_size", F.col("best.n").alias("keep_n"))


def _heavy(rows: DataFrame) -> DataFrame:
    """Verified winners of the digests that the sketch names, at most ``HEAVY`` rows."""
    short = F.xxhash64("digest")
    named = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {HEAVY}, {COUNTERS})").alias("top")).select(
        F.explode("top").alias("t")).where(F.col("t.count") > 1).select(F.col("t.item").alias("short"))
    return _winners(rows.withColumn("short", short).join(F.broadcast(named), "short", "left_semi").drop("short"))


def duplicate_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``."""
    rows = _thin(df, text, key)
    heavy = _heavy(rows).select("digest", F.col("keep_id").alias("h_id"), F.col("group_size").alias("h_size"),
                                F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where(F.col("hot").isNull()).select("doc_id", "digest", "n_chars")
    settled = marked.where("hot").select("doc_id", "digest", F.col("h_id").alias("keep_id"),
                                         F.col("h_size").alias("group_size"))
    ordinary = rest.join(_winners(rest), "digest").select("doc_id", "digest", "keep_id", "group_size")
    return settled.unionByName(ordinary).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _seen(digests: DataFrame) -> DataFrame:
    """``slot, bits``: a bitmap of the digests by hash, ``BITS`` bits in all whatever their number."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    return digests.groupBy(F.bitmap_bucket_number(spot).alias("slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, one per digest, with all their columns.

    Copies of frequent digests leave on the map side. Whether a digest may occur twice is read from a bitmap of bounded size;
    most rows are alone and stay where they are, and only the others are shuffled with their text.
    """
    rows = _thin(df, text, key)
    heavy = _heavy(rows).select(F.col("digest").alias("__heavy"), F.struct(
        F.col("keep_n").alias("n"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id")).alias("__best"))
    rest = rows.join(F.broadcast(heavy.select("__heavy")), F.col("digest") == F.col("__heavy"), "left_anti")
    bitmap = _seen(rest.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bitmap = bitmap.select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits"))

    place = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).cast("bigint").alias("n"), F.col(key).isNull().alias("none"),
                     F.col(key).alias("id"))
    spot = F.pmod(F.xxhash64("__digest"), F.lit(BITS))
    marked = once(df, __digest=digest(F.col(text)), __place=place).join(
        F.broadcast(heavy), F.col("__digest") == F.col("__heavy"), "left").join(
        F.broadcast(bitmap), F.bitmap_bucket_number(spot) == F.col("__slot"), "left")
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    twice = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    alone = marked.where(F.col("__best").isNull() & ~twice)
    # the best row of each digest, combined on the map side, so no group of ties meets in one task
    some = marked.where((F.col("__place") == F.col("__best")) | (F.col("__best").isNull() & twice)).groupBy("__digest").agg(
        F.min_by(F.struct(*df.columns), "__place").alias("__row"))
    return alone.select(*df.columns).unionByName(some.select("__row.*"))
