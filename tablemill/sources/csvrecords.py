"""CSV records of large files with line breaks in cells, read by many tasks.

Whether a line starts inside quotes depends on all lines before it, but only through one bit. So every line is a function of
that bit, and functions compose: a line keeps the bit, flips it, or sets it whatever it was (a line with a whole quoted cell
does that). The bit before a line is the last value set, flipped as often as flips followed; the same holds for the blocks of a
file, once a block is known as a function. Work is spread by block:

1. One aggregate over the lines tells, per block of the split file, whether a line opens a cell that it does not close.
   Where none does, as in most files, nothing else is needed and lines are records.
2. Blocks with such lines become functions by a window inside the block; blocks of a file are composed by a window over one
   small row per block.
3. Only the lines of blocks that hold an open cell are numbered; records of one line pass through, the others are joined.

A quote opens a cell at the start of a field only and is doubled inside one, as in the reader that parses the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions.text import plain_path
from tablemill.session import work_path

# 0: outside of quotes, 1: inside, 2: at a quote inside, which ends the cell or is the first of two.
STEP = """CASE WHEN s.{x} = 1 THEN 2 WHEN s.{x} = 2 AND e.blank THEN 1 WHEN e.field OR (s.{x} = 0 AND e.head) THEN 1 ELSE 0 END"""
LINE = f"""IF(instr(value, '"') = 0, named_struct('from_out', 0, 'from_in', 1), aggregate(
  slice(transform(split(value, '"', -1), (p, i) -> named_struct('blank', p = '', 'head', p = '' AND i = 0, 'field', endswith(p, sep))),
        1, length(value) - length(replace(value, '"', ''))),
  named_struct('a', 0, 'b', 1), (s, e) -> named_struct('a', {STEP.format(x="a")}, 'b', {STEP.format(x="b")}),
  s -> named_struct('from_out', int(s.a = 1), 'from_in', int(s.b = 1))))"""


def csv_lines(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """``file, block, seq, value, from_out, from_in``: the lines, and whether they end inside quotes for either start."""
    lines = spark.read.text(path, lineSep="\n").select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r$", "").alias("value"),
        F.lit(delimiter).alias("sep"))
    return lines.select("file", "block", "seq", "value", F.inline(F.array(F.expr(LINE))))


def line_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: does a line open a cell, and the block as a function where none does."""
    blocks = lines.groupBy("file", "block").agg(
        F.max("from_out").alias("opens"), F.min("from_in").alias("from_in"), F.min("seq").alias("first"))
    path = work_path(lines.sparkSession, "csv-blocks")
    blocks.write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def _before(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``out`` and ``inside``: the bit before a row, if it is 0 or 1 before the first row of its keys."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.when(F.col("from_out") > F.col("from_in"), 1).otherwise(0)).over(earlier), F.lit(0))
    counted = df.withColumn("__flips", flips)
    last = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "__flips")), ignorenulls=True).over(earlier)
    told = counted.withColumn("__set", last)
    known = (F.col("__set.from_out") + F.col("__flips") - F.col("__set.__flips")) % 2
    return told.withColumns({"out": F.coalesce(known, F.col("__flips") % 2), "inside": F.coalesce(
        known, (F.col("__flips") + 1) % 2)}).drop("__flips", "__set")


def _ends(out: Column) -> Column:
    return F.when(out == 1, F.col("from_in")).otherwise(F.col("from_out"))


def csv_records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``file, block, seq, record``: the records by the place of their first line; blank lines between records go."""
    place = ["file", "block"]
    busy = lines.join(blocks.where("opens = 1").select(*place), place, "left_semi")
    functions = _before(busy, place, "seq").groupBy(*place).agg(
        F.max_by(F.struct(_ends(F.col("out")).alias("from_out"), _ends(F.col("inside")).alias("from_in")), "seq").alias("f"))
    composed = blocks.join(functions, place, "left").select(
        *place, "opens", F.coalesce("f.from_out", F.lit(0)).alias("from_out"), F.coalesce("f.from_in", "from_in").alias("from_in"))
    starts = _before(composed, ["file"], "block").select(*place, F.col("out").alias("start"), "opens")
    spark, path = lines.sparkSession, work_path(lines.sparkSession, "csv-starts")
    starts.write.parquet(path)
    starts = spark.read.parquet(path)
    touched = starts.where("opens = 1 OR start = 1").select(*place, "start")

    calm = lines.join(touched, place, "left_anti").select(*place, "seq", F.col("value").alias("record"))
    states = _before(lines.join(touched, place), place, "seq").withColumn(
        "at", F.when(F.col("start") == 1, F.col("inside")).otherwise(F.col("out")))
    so_far = Window.partitionBy(*place).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = states.select(*place, "seq", "value", "at", _ends(F.col("at")).alias("end"), F.last(
        F.when(F.col("at") == 0, F.struct("block", "seq")), ignorenulls=True).over(so_far).alias("own"))
    path = work_path(spark, "csv-lines")
    begun.write.parquet(path)
    begun = spark.read.parquet(path)
    whole = begun.where("at = 0 AND end = 0").select(*place, "seq", F.col("value").alias("record"))
    # lines before the first record of a block belong to the last one begun in an earlier block
    last = begun.groupBy(*place).agg(F.max("own").alias("last"))
    carry = last.select(*place, F.last("last", ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    parts = begun.where("at = 1 OR end = 1").join(carry, place).select("file", F.coalesce("own", "carried").alias("own"), F.struct(
        "block", "seq", "value").alias("part"))
    joined = parts.groupBy("file", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "\n")
                                              .alias("record")).select("file", "own.block", "own.seq", "record")
    return calm.unionByName(whole).where(F.trim("record") != "").unionByName(joined)
