"""The proof of a written dataset finds every kind of damage."""

from pyspark.sql import functions as F

from tablemill.operators.proof import compare_rows


def one(source, output):
    r = compare_rows(source, output).first()
    return r.equal, r.source_rows, r.output_rows, list(r.different)


def test_damage_is_found(spark):
    base = spark.range(1000).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), "id")).alias("s"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"),
        F.array("id").alias("list"), F.expr("timestamp_micros(id * 1001)").alias("at"), F.encode(F.col("id").cast("string"), "utf-8").alias("raw"))
    moved = base.repartition(5, "s").select(*reversed(base.columns)).withColumn("id", F.col("id").cast("int"))
    assert one(base, moved) == (True, 1000, 1000, [])
    assert one(base, base.where("id <> 77"))[:3] == (False, 1000, 999)
    assert not one(base, base.unionByName(base.where("id = 3")))[0]
    twice = base.where("id <> 4").unionByName(base.where("id = 3"))
    assert one(base, twice)[:3] == (False, 1000, 1000)
    assert one(base, base.withColumn("x", F.when(F.col("id") == 9, -1.0).otherwise(F.col("x")))) == (False, 1000, 1000, ["x"])
    assert one(base, base.withColumn("s", F.coalesce("s", F.lit("")))) == (False, 1000, 1000, ["s"])
    # nulls that change their column, and values that change their row
    assert one(base, base.withColumns({"a": F.col("b"), "b": F.col("a")})) == (False, 1000, 1000, ["a", "b"])
    swapped = base.withColumn("x", ((F.col("id") + 1) % 1000 % 7).cast("double"))
    assert one(base, swapped)[0] is False
    assert one(base.select("id"), base.select("id", "x")) == (False, 1000, 1000, ["x"])
    empty = base.where("false")
    assert one(empty, empty) == (True, 0, 0, []) and one(base, empty)[:3] == (False, 1000, 0)
