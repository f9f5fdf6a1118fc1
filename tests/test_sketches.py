"""Sketches against exact counts, merged over days and groupings."""

from pyspark.sql import functions as F

from tablemill.operators import sketches as sk


def test_merged_sketches_stay_within_their_bounds(spark, tmp_path):
    df = spark.range(400_000).select(
        F.pmod(F.xxhash64("id"), F.lit(9)).alias("day"), (F.col("id") % 4).alias("g"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(60_000)).alias("user"),
        F.when(F.col("id") % 10 > 0, F.pow(F.rand(5) * 10, 2)).alias("x"))
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    sk.sketch_table(df, ["day", "g"], {"users": F.col("user")}, {"xs": F.col("x")}).write.parquet(str(tmp_path / "sketches"))
    table = spark.read.parquet(str(tmp_path / "sketches"))
    assert table.count() == 36
    for keys in (["g"], ["day"], []):
        merged = sk.merge_sketches(table, keys, ["users"], ["xs"]).select(
            *keys, "rows", sk.distinct_count("users").alias("users"), sk.quantile("xs", 0.5).alias("median"), sk.quantile("xs", 0.99).alias("high"))
        exact = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("d"))
        for r in (merged.join(exact, keys) if keys else merged.join(exact)).collect():
            assert r.rows == r.n and abs(r.users - r.d) <= 4 * sk.DISTINCT_ERROR * r.d
            part = df
            for k in keys:
                part = part.where(F.col(k) == r[k])
            below = part.where("x is not null").agg(*[F.avg((F.col("x") < v).cast("double")) for v in (r.median, r.high)]).first()
            assert abs(below[0] - 0.5) < 4 * sk.RANK_ERROR and abs(below[1] - 0.99) < 4 * sk.RANK_ERROR
    rolled = sk.rollup_sketches(table, ["g", "day"], ["users"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    assert sorted((r.level, r.n, r.rows) for r in rolled.collect()) == [(0, 36, 400_000), (1, 4, 400_000), (2, 1, 400_000)]


def test_set_counts_and_odd_rows(spark):
    df = spark.range(90_000).select(F.explode(F.array_compact(F.array(F.when(F.col("id") < 60_000, "a"), F.when(F.col("id") >= 40_000, "b")))).alias("s"), "id")
    table = sk.sketch_table(df, ["s"], {"ids": F.col("id")}, {})
    pair = table.where("s = 'a'").select(F.col("ids").alias("a")).join(table.where("s = 'b'").select(F.col("ids").alias("b")))
    r = pair.select(sk.set_counts(F.col("a"), F.col("b")).alias("c")).first().c
    for got, exact in zip(r, (20_000, 40_000, 30_000, 90_000)):
        assert abs(got - exact) <= 4 * sk.DISTINCT_ERROR * 90_000
    nulls = spark.createDataFrame([("a", None), ("a", None), ("b", 3.0)], "s string, x double")
    got = sk.sketch_table(nulls, ["s"], {"d": F.col("x").cast("string")}, {"q": F.col("x")}).select(
        "s", "rows", sk.distinct_count("d").alias("d"), sk.quantile("q", 0.5).alias("m")).orderBy("s").collect()
    assert [tuple(r) for r in got] == [("a", 2, 0, None), ("b", 1, 1, 3.0)]
    assert sk.sketch_table(nulls.where("false"), ["s"], {"d": F.col("x").cast("string")}, {"q": F.col("x")}).count() == 0
