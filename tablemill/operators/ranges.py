"""Joins and windows along an ordered column that stay spread when one key holds most rows.

* ``equal_ranges`` cuts the rows of a hot key into ranges of about equal size, wherever its values crowd: the cuts are
  quantiles of a mergeable sketch, taken for hot keys only, and a row finds its range by binary search in them.
* ``positions`` numbers the rows of a key: a window inside each range, and the counts of the ranges before it.
* ``rows_frames`` evaluates window functions over frames of rows. Blocks of consecutive positions take along the rows that
  their frames reach into the neighbours (a halo), so any native function works inside a block.
* ``ranks`` and ``ntile`` come from positions and prefix counts of distinct values.
* ``range_join`` finds the intervals that hold a point by equal keys: an interval meets a few aligned blocks of a size by its
  length, and a point lies in one block of each size. Where the times of a block crowd at the ends of intervals, the pieces there are
  cut further into blocks of ``2 ** STEP`` to a power, of which exactly one holds a point inside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.ordering import RANGE_ROWS
from tablemill.session import work_path

CUTS = 4096  # most ranges of one key
STEP = 4  # bits by which the sizes of the blocks of a range join differ
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clock(df: DataFrame, order: str) -> Column:
    """A column of times or numbers as one that the quantile sketch takes and that compares alike."""
    if isinstance(df.schema[order].dataType, TIMES):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join on keys that may be null; the keys of the right side go."""
    renamed = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys] or [F.lit(True)]
    return left.join(renamed, on, how).drop(*[f"__on_{k}" for k in keys])


def equal_ranges(df: DataFrame, keys: Sequence[str], value: Column, name: str = "__range", rows: int = RANGE_ROWS) -> DataFrame:
    """Add the number of the range that a row's ``value`` lies in; it never decreases with the value within a key.

    Keys of up to ``rows`` rows are one range. Rows with equal keys and values share a range; null values come first.
    """
    staged = df.withColumn("__value", value)
    hot = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    parts = [i / CUTS for i in range(1, CUTS)]
    cuts = _same(staged.select(*keys, "__value"), hot.withColumn("hot", F.lit(True)), keys, "inner").groupBy(*keys).agg(
        F.percentile_approx("__value", parts, 10_000).alias("all"), F.max("n").alias("n"))
    # as many of the quantiles as the key needs
    every = F.greatest(F.lit(1), F.floor(F.lit(CUTS * rows) / F.col("n"))).cast("int")
    cuts = _saved(cuts.select(*keys, F.array_distinct(F.filter("all", lambda c, i: (i + 1) % every == 0)).alias("__cuts")), "cuts")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(CUTS.bit_length())), F.struct(F.lit(0).alias("a"), F.size("__cuts").alias("b")),
        lambda s, i: F.when(s["a"] >= s["b"], s).when(
            F.get("__cuts", ((s["a"] + s["b"]) / 2).cast("int")) < F.col("__value"),
            F.struct((((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).cast("int").alias("b"))), lambda s: s["a"])
    joined = _same(staged, cuts, keys)
    return joined.withColumn(name, F.when(F.col("__cuts").isNull() | F.col("__value").isNull(), 0).otherwise(found)).drop("__cuts", "__value")


def _order(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_first(c) for c in order]


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", rows: int = RANGE_ROWS) -> DataFrame:
    """Add the place of a row among those of its key, from 1 up; rows with equal ``order`` are numbered in any order.

    The first order column is a time or a number. The result is a written table, so the numbers stay.
    """
    ranged = _saved(equal_ranges(df, keys, clock(df, order[0]), rows=rows), "ranged")
    counts = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*_order(order)))
    numbered = _same(ranged.withColumn("__at", inside), before, [*keys, "__range"], "inner")
    return _saved(numbered.withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name), "positions")


def rows_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], preceding: int = 0,
                following: int = 0, rows: int = RANGE_ROWS) -> DataFrame:
    """Add aggregates over the frame from ``preceding`` rows before to ``following`` rows after each row of a key.

    ``F.first`` and ``F.last`` give lag and lead where the frame is whole; see ``shifted``. ``order`` should tell rows apart.
    """
    block = max(rows, preceding, following, 1)
    placed = positions(df, keys, order, "__at", rows).withColumn("__at", F.col("__at") - 1)
    own = F.floor(F.col("__at") / block)
    # a row also goes to the next block where it is among its frames' preceding rows, and to the one before likewise
    homes = F.array_compact(F.array(
        own, F.when(F.col("__at") % block >= block - preceding, own + 1), F.when((F.col("__at") % block < following) & (own > 0), own - 1)))
    spread = placed.withColumn("__own", own).withColumn("__block", F.explode(homes))
    frame = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(-preceding, following)
    return spread.select("*", *[v.over(frame).alias(n) for n, v in values.items()]).where(
        F.col("__own") == F.col("__block")).select(*df.columns, *values)


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, offset: int, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Add the value of ``column`` ``offset`` rows later (earlier where negative) in the same key, null beyond its ends."""
    reach, edge = abs(offset), F.first if offset < 0 else F.last
    out = rows_frames(df, keys, order, {"__count": F.count(F.lit(1)), name: edge(F.col(column))}, reach if offset < 0 else 0,
                      reach if offset > 0 else 0, rows)
    return out.withColumn(name, F.when(F.col("__count") == reach + 1, F.col(name))).drop("__count")


def ranks(df: DataFrame, keys: Sequence[str], order: str, rank: str = "rank", dense: str = "dense_rank", rows: int = RANGE_ROWS) -> DataFrame:
    """Add rank and dense rank by ``order``: prefix counts over the distinct values of a key, joined back by value."""
    values = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__n"))
    placed = positions(values, keys, [order], dense, rows)
    ranged = equal_ranges(placed, keys, clock(placed, order), rows=rows)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__total"))
    before = sums.select(*keys, "__range", F.coalesce(F.sum("__total").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy(dense).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    ranked = _same(ranged.withColumn("__in", inside), before, [*keys, "__range"], "inner").select(
        *keys, order, (F.col("__in") + F.col("__before") + 1).alias(rank), dense)
    return _same(df, ranked, [*keys, order], "inner")


def ntile(df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int, name: str = "tile", rows: int = RANGE_ROWS) -> DataFrame:
    """Add the tile of a row when those of its key are cut into ``tiles`` of sizes at most one apart, larger ones first."""
    placed = positions(df, keys, order, "__at", rows)
    counted = _same(placed, placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "inner")
    size, more = F.floor(F.col("__n") / tiles), F.col("__n") % tiles
    at, edge = F.col("__at") - 1, F.col("__n") % tiles * (F.floor(F.col("__n") / tiles) + 1)
    tile = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1)))) + 1
    return counted.withColumn(name, tile.cast("int")).select(*df.columns, name)


# The aligned blocks of an interval [a, z): the largest that starts at a and ends by z, and so on from its end.
LARGEST = "filter(levels, l -> s.at % (shiftleft(1L, l)) = 0 AND s.at + (shiftleft(1L, l)) <= z)[0]"
BLOCKS = f"""aggregate(sequence(1, most), named_struct('at', a, 'out', array_repeat(named_struct('level', 0, 'block', 0L), 0)),
  (s, i) -> IF(s.at >= z, s, transform(array({LARGEST}), l -> named_struct(
     'at', s.at + (shiftleft(1L, l)), 'out', array_append(s.out, named_struct('level', l, 'block', shiftright(s.at, l)))))[0]),
  s -> s.out)"""


WIDTH = 3  # bits by which the block sizes of intervals of different lengths differ
CROWD = 64  # comparisons per row that a block may cost before its times are told apart by smaller blocks


def interval_pieces(intervals: DataFrame, low: str, high: str, on: Sequence[str] = ()) -> DataFrame:
    """``on, __row, __a, __z, __level, __block, __edge``: the 1 to 17 blocks, of a size by its length, that an interval meets.

    ``__edge`` marks blocks that the interval does not fill. Empty intervals and those with a null bound or key have none.
    """
    shift = 1 << 60
    bits = F.length(F.bin(F.col("__z") - F.col("__a"))) - 1
    row = F.struct(*[F.col(c) for c in intervals.columns]).alias("__row")
    whole = intervals.select(*on, row, (clock(intervals, low).cast("bigint") + shift).alias("__a"),
                             (clock(intervals, high).cast("bigint") + shift).alias("__z")).where("__a < __z")
    for k in on:
        whole = whole.where(F.col(k).isNotNull())
    sized = whole.withColumn("__level", (F.greatest(F.floor((bits - 1) / WIDTH), F.lit(0)) * WIDTH).cast("int"))
    cut = sized.withColumn("__block", F.explode(F.expr("sequence(shiftright(__a, __level), shiftright(__z - 1, __level))")))
    return cut.withColumn("__edge", F.expr("shiftleft(__block, __level) < __a OR shiftleft(__block + 1, __level) > __z"))


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of a point and an interval of the same keys with ``low <= point < high``.

    Whole numbers below ``2 ** 60`` in size, dates or times. Columns of the two sides have different names but for the keys;
    rows with a null key, point or bound find no partner.
    """
    pieces = interval_pieces(intervals, low, high, on)
    # a point lies in one block of each size that occurs: 21 at most, and one where intervals are about equally long
    levels = sorted(r[0] for r in pieces.select("__level").distinct().collect()) or [0]
    at = clock(points, point).cast("bigint") + (1 << 60)
    spots = points.where(F.col(point).isNotNull()).select(*on, F.struct(*[F.col(c) for c in points.columns]).alias("__point"), at.alias(
        "__at")).withColumn("__spot", F.explode(F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright("__at", l).alias("block")) for l in levels])))
    spots = spots.select(*on, "__point", "__at", F.col("__spot.level").alias("__level"), F.col("__spot.block").alias("__block"))
    cell = [*on, "__level", "__block"]
    inside = (F.col("__at") >= F.col("__a")) & (F.col("__at") < F.col("__z"))
    out = [*on, *[F.col(f"__point.`{c}`") for c in points.columns if c not in on], *[F.col(f"__row.`{c}`") for c in intervals.columns if c not in on]]

    # pairs in a block that an interval fills are all wanted; at its edges those of one block could be many and none wanted
    ends = pieces.where("__edge").groupBy(*cell).agg(F.count(F.lit(1)).alias("i"))
    held = spots.groupBy(*cell).agg(F.count(F.lit(1)).alias("p"))
    crowded = _saved(ends.join(held, cell).where(F.col("i") * F.col("p") > CROWD * (F.col("i") + F.col("p"))).select(*cell), "crowded")
    if crowded.isEmpty():
        return spots.join(pieces, cell).where(inside).select(*out)
    full = pieces.where("NOT __edge").unionByName(pieces.where("__edge").join(crowded, cell, "left_anti").select(*pieces.columns))
    pairs = spots.join(full, cell).where(inside).select(*out)
    edges = pieces.where("__edge").join(crowded, cell, "left_semi").withColumns({
        "a": F.expr("greatest(__a, shiftleft(__block, __level))"), "z": F.expr("least(__z, shiftleft(__block + 1, __level))")})
    small = list(range(0, levels[-1] + 1, STEP))
    most = 2 * (1 << STEP) * len(small)
    edges = edges.withColumns({"levels": F.array(*[F.lit(l) for l in small[::-1]]), "most": F.lit(most)}).withColumn(
        "spot", F.explode(F.expr(BLOCKS))).select(*cell, "__row", F.col("spot.level").alias("__l"), F.col("spot.block").alias("__b"))
    fine = spots.join(crowded, cell, "left_semi").withColumn("__s", F.explode(F.array(*[
        F.struct(F.lit(l).alias("level"), F.shiftright("__at", l).alias("block")) for l in small]))).select(
        *cell, "__point", F.col("__s.level").alias("__l"), F.col("__s.block").alias("__b"))
    return pairs.unionByName(fine.join(edges, [*cell, "__l", "__b"]).select(*out))
