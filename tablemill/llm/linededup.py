"""Line dedup by a deletion-neighbourhood join.

Two lines are alike when their edit distance is at most one. A line is dropped when an earlier line, by (document id, line
number), is equal or alike; so the earliest of any group stays, and a text keeps its other lines in order.

1. Lines become distinct lines with their earliest place; equal lines of any length are settled there. The ``FREQUENT`` lines
   with the most copies are broadcast, so their copies are found on the map side.
2. Of two lines that one edit turns into each other, the first or the last half is the same. Lines are keyed by both
   halves, for their own length and the next one; only lines that share a key with another line go on. Nothing that has a
   neighbour is lost, and ordinary prose ends here.
3. Those lines emit their deletion neighbourhood as hashed keys: the line itself and every variant without one character
   (of the half that is not shared), with the place of that character. Lines that meet in one variant at one place differ in that character; a line that is
   the variant itself has one character less. Either way the earliest of those that meet is found by a minimum per key,
   never by listing the pairs of a group.
4. Each line is verified against that earlier one by edit distance.

Defined results: null texts have no lines; empty lines carry layout, not content, and stay; lines of fewer than ``min_chars``
code points go where an earlier line is equal, not where one is alike, as one edit turns "12" into "13"; lines of any length
take part whole; a null id sorts first; rows repeated in full share their places,
so a line is kept or dropped in all of them alike; an empty table gives an empty result; ``drop_lines`` passes other
columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.tables import let
from tablemill.session import work_path

MIN_CHARS = 10
FREQUENT = 512

# For the longer length c of a pair: the first (c - 1) div 2 characters and the last c - 1 less that many.
HALVES = ", ".join(
    f"xxhash64({c}, '{side}', {side}(line, {size.format(c=c)}))"
    for c in ("n", "n + 1") for side, size in (("left", "({c} - 1) div 2"), ("right", "{c} - 1 - ({c} - 1) div 2")))
# Lines that share the first half differ behind it, lines that share the last half before it; both meet in the middle.
VARIANTS = ("concat(array(struct(xxhash64(line) AS variant, 0 AS place)), transform(sequence("
            "IF(same_end, 1, (n - 1) div 2 + 1), IF(same_start, n, (n - 1) div 2 + 1)), i -> "
            "struct(xxhash64(concat(left(line, i - 1), substr(line, i + 1))) AS variant, i AS place)))")


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, line_no, line, n, hash`` of all lines that are not empty; numbers start at 0."""
    rows = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("n", F.length("line")).where("n > 0").withColumn("hash", F.unhex(F.md5("line")))


def _alike(df: DataFrame, lines: DataFrame, text: str, key: str) -> DataFrame:
    """``hash`` of the distinct lines that an earlier line is alike to."""
    # a short name of the line is enough here: a clash lets one more line go on, and loses none
    keyed = lines.select(F.xxhash64("hash").alias("short"), F.posexplode("halves").alias("side", "half"))
    shared = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    near = keyed.join(shared, "half", "left_semi").groupBy("short").agg(
        F.bool_or(F.col("side") % 2 == 0).alias("same_start"), F.bool_or(F.col("side") % 2 == 1).alias("same_end"))
    wanted = lines.select("hash", "first", F.xxhash64("hash").alias("short")).join(near, "short").drop("short")
    spots = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("first.line_no").alias("spots"))
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(spots, F.col("id").eqNullSafe(F.col("doc_id")))
    spot_lines = let(F.split("text", "\n", -1), lambda all_: F.transform(
        "spots", lambda i: F.struct(i.alias("line_no"), F.get(all_, i).alias("line"))))
    held = texts.select("doc_id", F.inline(spot_lines)).where(F.col("line").isNotNull()).select(
        "line", F.unhex(F.md5("line")).alias("hash"), F.length("line").alias("n"), F.struct("doc_id", "line_no").alias("first"))
    near = _saved(held.join(wanted.drop("first"), "hash").dropDuplicates(["hash"]), "near-lines")

    keys = near.select("hash", "first", F.inline(F.expr(VARIANTS)))
    by_variant, by_place = Window.partitionBy("variant"), Window.partitionBy("variant", "place")
    here = F.struct("first", "hash")
    met = keys.select("hash", "first", "place",
                      F.min(F.when(F.col("place") == 0, here)).over(by_variant).alias("whole"),
                      F.min(F.when(F.col("place") > 0, here)).over(by_variant).alias("cut"),
                      F.min(here).over(by_place).alias("same"))
    earlier = F.when(F.col("place") == 0, F.array("cut")).otherwise(F.array("whole", "same"))
    pairs = met.select("hash", "first", F.explode(earlier).alias("e")).where("e.first < first").select(
        "hash", F.col("e.hash").alias("other")).distinct()
    mine, theirs = near.select("hash", "line"), near.select(F.col("hash").alias("other"), F.col("line").alias("line_2"))
    return pairs.join(mine, "hash").join(theirs, "other").where(
        F.levenshtein("line", "line_2", 1) >= 0).select("hash").distinct()


def line_decisions(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, dropped``: the numbers of the lines to drop, for every document that loses one."""
    rows = lines_of(df, text, key)
    lines = _saved(rows.groupBy("hash").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first(F.when(F.col("n") >= min_chars, F.expr(f"array({HALVES})"))).alias("halves")), "lines")
    alike = _alike(df, lines.where("halves IS NOT NULL"), text, key).withColumn("alike", F.lit(True))
    fate = lines.join(alike, "hash", "left").where("copies > 1 OR alike").select(
        "hash", "first", "copies", F.coalesce("alike", F.lit(False)).alias("alike"))
    fate = _saved(fate, "fate")
    frequent = fate.orderBy(F.desc("copies"), "hash").limit(FREQUENT).select("hash", F.struct("first", "alike").alias("known"))
    marked = rows.select("doc_id", "line_no", "hash").join(F.broadcast(frequent), "hash", "left")
    settled = marked.where("known IS NOT NULL").select("doc_id", "line_no", "known.first", "known.alike")
    others = marked.where("known IS NULL").join(fate, "hash").select("doc_id", "line_no", "first", "alike")
    gone = settled.unionByName(others).where(F.col("alike") | (F.struct("doc_id", "line_no") > F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def drop_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with the dropped lines taken out of ``text``."""
    gone = line_decisions(df, text, key, min_chars).withColumnsRenamed({"doc_id": "__id", "dropped": "__gone"})
    kept = let(F.split(F.col(text), "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone"), lambda i: F.get(lines, i)), "\n"))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    joined = df.join(gone, F.col(key).eqNullSafe(F.col("__id")), "left")
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in df.columns])
