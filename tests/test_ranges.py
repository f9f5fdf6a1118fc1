"""Joins and windows along an ordered column against plain ones, with a key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablemill.operators import query, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.choice([1, 2, 3, None, 99])
        # the times of the hot key crowd into a few seconds
        at = None if i % 97 == 0 else rng.randint(1000, 1040) if key == 0 else rng.randint(-100_000, 100_000)
        out.append((i, key, at, rng.randint(0, 50)))
    return spark.createDataFrame(out, "id int, key int, at bigint, v int").repartition(6)


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.select(*columns).collect(), key=key) == sorted(want.select(*columns).collect(), key=key)


def test_ranges_are_even_and_ordered(rows):
    got = ranges.equal_ranges(rows, ["key"], F.col("at"), "part", rows=40)
    sizes = {(r.key, r.part): r["count"] for r in got.groupBy("key", "part").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == 0]
    assert len(hot) > 5 and max(hot) < 80
    spans = got.where("at is not null").groupBy("key", "part").agg(F.min("at").alias("a"), F.max("at").alias("z")).orderBy("key", "part").collect()
    for x, y in zip(spans, spans[1:]):
        assert x.key != y.key or x.z < y.a


def test_positions_frames_and_shifts(rows):
    w = Window.partitionBy("key").orderBy(F.asc_nulls_first("at"), "id")
    same(ranges.positions(rows, ["key"], ["at", "id"], rows=25), rows.withColumn("position", F.row_number().over(w)))
    for before, after in ((3, 0), (0, 2), (60, 45)):
        frame = w.rowsBetween(-before, after)
        values = {"s": F.sum("v"), "n": F.count("v"), "low": F.min("v"), "f": F.first("id"), "l": F.last("id")}
        same(ranges.rows_frames(rows, ["key"], ["at", "id"], values, before, after, rows=25),
             rows.select("*", *[v.over(frame).alias(n) for n, v in values.items()]))
    for offset in (-4, 1, 30):
        same(ranges.shifted(rows, ["key"], ["at", "id"], "v", offset, "other", rows=25),
             rows.withColumn("other", F.lead("v", offset).over(w) if offset > 0 else F.lag("v", -offset).over(w)))


def test_ranks_and_tiles(rows):
    w = Window.partitionBy("key").orderBy(F.asc_nulls_first("at"))
    same(ranges.ranks(rows, ["key"], "at", rows=25), rows.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)}))
    total = Window.partitionBy("key").orderBy(F.asc_nulls_first("at"), "id")
    for tiles in (3, 7, 1000):
        same(ranges.ntile(rows, ["key"], ["at", "id"], tiles, rows=25), rows.withColumn("tile", F.ntile(tiles).over(total)))


def test_a_hot_key_is_spread(rows):
    framed = ranges.positions(rows, ["key"], ["at", "id"], rows=25)
    blocks = framed.where("key = 0").groupBy(F.floor((F.col("position") - 1) / 25)).count()
    assert blocks.count() >= 12 and blocks.agg(F.max("count")).first()[0] <= 25


def test_asof_join_of_a_crowded_key(spark, rows):
    left, right = rows.where("id % 2 = 0").select("id", "key", "at"), rows.where("id % 2 = 1").select(
        "key", F.col("id").alias("other"), F.col("at").alias("then"))
    # one right row for each time, so the latest is one
    right = right.groupBy("key", "then").agg(F.max("other").alias("other"))
    want = left.join(right.where("then is not null"), (left.key == right.key) & (right.then <= left.at), "left").groupBy("id").agg(
        F.max(F.struct("then", "other")).alias("m")).select("id", F.col("m.then").alias("then"), F.col("m.other").alias("other"))
    for size in (1_000_000, 20):
        same(query.asof_join(left, right, ["key"], "at", "then", rows=size).select("id", "then", "other"), want)


@pytest.mark.parametrize("longest", [1, 30, 5000, 10**7])
def test_range_join(spark, rows, longest):
    rng = random.Random(longest)
    made = [(i, rng.choice([0, 1, 2, None]), (a := rng.randint(-90_000, 90_000)), None if i == 5 else a + rng.randint(-3, longest)) for i in range(120)]
    made += [(500, 0, 1000, 1041), (501, 0, -(1 << 50), 1 << 50), (502, 1, 7, 7)]
    spans = spark.createDataFrame(made, "span int, key int, lo bigint, hi bigint")
    points = rows.select("id", "key", "at")
    for on in (["key"], []):
        left, right = (points, spans) if on else (points.drop("key"), spans.drop("key"))
        got = ranges.range_join(left, right, "at", "lo", "hi", on)
        cond = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
        want = left.join(right, on, "inner").where(cond) if on else left.join(right, cond)
        same(got, want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_weighted_samples(spark):
    df = spark.range(6000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 6 < 3, 1.0).otherwise(3.0).alias("w"))
    odd = spark.createDataFrame([(9000, None, 1.0), (9001, 5, 0.0), (9002, 5, None), (9003, 5, -1.0)], "id bigint, g bigint, w double")
    heavy = 0
    for seed in range(5):
        got = query.sample_by_weight(df.unionByName(odd), ["g"], 300, F.col("w"), ["id"], seed).collect()
        assert len({r.id for r in got}) == len(got) == 901
        heavy += sum(r.w == 3.0 for r in got)
        again = query.sample_by_weight(df.unionByName(odd).repartition(7), ["g"], 300, F.col("w"), ["id"], seed).collect()
        assert {r.id for r in again} == {r.id for r in got}
    assert 0.68 < heavy / 4500 < 0.80  # 3 of 4, less what is drawn without replacement


def test_range_join_cuts_intervals_into_few_pieces(spark):
    rng = random.Random(3)
    day = 86_400_000_000
    spans = spark.createDataFrame([(i, i % 3, (a := rng.randint(0, 30 * day)), a + rng.choice([1, 5, day, day + 1])) for i in range(300)],
                                  "span int, key int, lo bigint, hi bigint")
    pieces = ranges.interval_pieces(spans, "lo", "hi", ["key"]).groupBy("__row.span").count()
    assert pieces.count() == 300 and pieces.agg(F.max("count")).first()[0] <= 17


def test_range_join_tells_crowded_edges_apart(spark, monkeypatch):
    # the points of a block lie just before the intervals that begin in it
    spans = spark.createDataFrame([(i, 1, 1000 + i, 9000 + i) for i in range(400)], "span int, key int, lo bigint, hi bigint")
    points = spark.createDataFrame([(i, 1, 700 + i) for i in range(400)] + [(1000 + i, 1, 8900 + i) for i in range(300)],
                                   "id int, key int, at bigint")
    want = points.join(spans, "key").where("at >= lo AND at < hi").select("key", "id", "at", "span", "lo", "hi")
    for crowd in (1, 64):
        monkeypatch.setattr(ranges, "CROWD", crowd)
        same(ranges.range_join(points, spans, "at", "lo", "hi", ["key"]).select(want.columns), want)
