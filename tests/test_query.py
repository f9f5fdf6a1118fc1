import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators.query import asof_join, audit_queries, restricted_sql, validate_query

ALLOWED = ["SELECT * FROM data WHERE amount > 0", "WITH x AS (SELECT * FROM data) SELECT * FROM x"]
BLOCKED = [
    "DELETE FROM data", "ATTACH 'x' AS y", "INSTALL httpfs", "LOAD httpfs", "PRAGMA database_list",
    "SELECT 1; DROP TABLE data", "SELECT * FROM 'https://example.com/x'", "SELECT * FROM read_parquet('x')",
    "SELECT * FROM read_csv_auto('x')", "SELECT readfile('x')", "SELECT reflect('java.lang.System', 'exit')",
    "SELECT java_method('a', 'b')", "SELECT TRANSFORM(a) USING 'cat' FROM data", "SELECT * FROM data WHERE a = 'update'",
    "SELECT 1;",
]


@pytest.mark.parametrize("query", ALLOWED)
def test_allowed(query):
    assert validate_query("  " + query + "\n") == query


@pytest.mark.parametrize("query", BLOCKED)
def test_blocked(query):
    with pytest.raises(ValueError, match="DATA_QUERY_RESTRICTED"):
        validate_query(query)


def test_audit_agrees_with_validation(frame):
    rows = [(i, q) for i, q in enumerate(ALLOWED + BLOCKED + ["", " \t\n"])]
    found = {r["i"]: r for r in audit_queries(frame(rows, "i int, q string"), "q").collect()}
    for i, query in rows:
        try:
            validate_query(query)
            assert found[i]["allowed"] and found[i]["reason"] is None
        except ValueError as error:
            assert str(error) == f"{found[i]['code']}: {found[i]['reason']}"


def test_only_given_views(spark, frame, tmp_path):
    data = frame([(1, 2)], "a int, b int")
    assert restricted_sql({"data": data}, "WITH t AS (SELECT a FROM data) SELECT a + 1 AS x FROM t").first()["x"] == 2
    data.write.parquet(str(tmp_path / "p"))
    for query in (f"SELECT * FROM parquet.`{tmp_path}/p`", "SELECT * FROM other", "SELECT (SELECT max(z) FROM hidden) AS z FROM data"):
        with pytest.raises(ValueError, match="DATA_QUERY_RESTRICTED"):
            restricted_sql({"data": data}, query)
    with pytest.raises(ValueError, match="DATA_QUERY_INVALID"):
        restricted_sql({"data": data}, "SELECT ((")


HIDDEN = ["SELECT ', hidden as (' AS s, v FROM hidden", "SELECT v /*, hidden as ( */ FROM hidden",
          "SELECT v FROM IDENTIFIER('hidden')", "SELECT * FROM (WITH hidden AS (SELECT 1 AS v) SELECT v FROM hidden) JOIN hidden",
          "SELECT a FROM data WHERE a IN (SELECT v FROM hidden)", "SELECT IDENTIFIER('a') FROM data", "TABLE hidden",
          "SELECT * FROM data, LATERAL (SELECT v FROM hidden)", "WITH x AS (SELECT v FROM hidden) SELECT * FROM x"]


@pytest.mark.parametrize("query", HIDDEN)
def test_hidden_views_stay_hidden(frame, query):
    frame([(7,)], "v int").createOrReplaceTempView("hidden")
    with pytest.raises(ValueError, match="DATA_QUERY_RESTRICTED"):
        restricted_sql({"data": frame([(1,)], "a int")}, query)


def test_views_of_the_caller_stay(spark, frame):
    frame([(5,)], "a int").createOrReplaceTempView("data")
    assert restricted_sql({"data": frame([(1,)], "a int"), "extra": frame([(2,)], "b int")}, "SELECT a + b AS c FROM data JOIN extra").first()[0] == 3
    assert spark.table("data").first()[0] == 5
    assert not spark.catalog.tableExists("extra")
    spark.catalog.dropTempView("data")


def test_asof_join_against_brute_force(frame):
    rnd = random.Random(3)
    # one key holds most rows, and is cut into many ranges
    left = [(i, rnd.choice(["hot"] * 8 + ["a", "b"]), rnd.randrange(10_000)) for i in range(300)] + [(900, None, 5)]
    right = [(i, rnd.choice(["hot"] * 8 + ["a", "c"]), t) for i, t in enumerate(rnd.sample(range(10_000), 200))]
    got = asof_join(frame(left, "id int, k string, t int"), frame(right, "rid int, k string, t int"), ["k"], "t", "t", 97)
    found = {r["id"]: r["rid"] for r in got.collect()}
    for i, key, time in left:
        best = max(((t, r) for r, k, t in right if k == key and t <= time), default=(None, None))
        assert found[i] == best[1]
    assert len(found) == len(left)
    assert "t_right" in got.columns


def test_asof_join_splits_a_hot_key(frame):
    left = frame([(1, "a", 1)], "id int, k string, t int")
    plan = asof_join(left, left, ["k"], "t", "t", 10)._jdf.queryExecution().toString()
    assert "__range" in plan


def test_views_with_nested_subqueries(frame):
    data = frame([(1,), (2,), (3,)], "a int")
    df = restricted_sql({"data": data}, "SELECT a FROM data d WHERE a >= (SELECT avg(a) FROM data) ORDER BY a")
    assert [r["a"] for r in df.collect()] == [2, 3]
    assert df.select(F.max("a")).first()[0] == 3
