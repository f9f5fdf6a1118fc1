import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tablemill.operators import jsonbridge, validate, workbook
from tablemill.sinks import writers
from tablemill.sources import tabular
from tablemill.sources.sqlite import read_sqlite, sqlite_catalogue


def rows(df):
    return [tuple(r) for r in df.collect()]


def raw(frame, texts):
    return jsonbridge.normalize_rows(frame(list(enumerate(texts)), "row_index bigint, json string"), "json", "row_index")


def test_ragged_columns_keep_first_seen_order(frame):
    data = raw(frame, ['{"a":1,"nested":{"x":true}}', '{"b":"y"}'])
    columns = jsonbridge.ordered_columns(data)
    assert columns == ["a", "nested", "b"]
    table = jsonbridge.rows_to_table(data, columns)
    lines = [r[0] for r in table.select(jsonbridge.csv_line(table)).collect()]
    assert lines == ['1,"{""x"":true}",', ",,y"]


def test_primitive_rows(frame):
    data = raw(frame, ['{"a":1}', "42"])
    columns = jsonbridge.ordered_columns(data)
    assert columns == ["a", "value", "row_index"]
    assert rows(jsonbridge.rows_to_table(data, columns)) == [("1", None, None), (None, "42", "1")]


def test_index_like_keys_come_first(frame):
    assert jsonbridge.ordered_columns(raw(frame, ['{"b":1,"10":1,"2":1,"01":1}'])) == ["2", "10", "b", "01"]


def test_column_limit(frame):
    with pytest.raises(ValueError, match="DATA_COLUMN_LIMIT"):
        jsonbridge.ordered_columns(raw(frame, [json.dumps({f"k{i}": 1 for i in range(6)})]), max_columns=5)


@pytest.mark.parametrize("text, good", [
    ('{"a":1}', True), ("42", True), ("null", True), ('{"a":1} x', False), ("1],[2", False), ("1,2", False), ('1,"end":1}', False),
    ("{'a':1}", False), ("", False), ("[{broken", False), ("007", False), ('"a\\u00e9"', True)])
def test_is_json(frame, text, good):
    assert frame([(text,)], "t string").select(jsonbridge.is_json(F.col("t"))).first()[0] is good


def test_affinity(frame):
    data = raw(frame, ['{"i":1,"r":1,"t":1,"b":true,"n":null,"w":1.0,"o":{}}', '{"i":2,"r":1.5,"t":"x","b":false,"n":null,"w":3}'])
    found = dict(rows(jsonbridge.infer_affinity(data)))
    assert found == {"i": "INTEGER", "r": "REAL", "t": "TEXT", "b": "INTEGER", "n": "TEXT", "w": "INTEGER", "o": "TEXT"}
    # later rows do not count for the types
    assert dict(rows(jsonbridge.infer_affinity(data, sample=1)))["r"] == "INTEGER"


def test_retyping(frame):
    data = frame([("1", "1", "007", "true", "2024-01-02", "2024-01-02 03:04:05", "", "x"),
                  ("-2", "1.5", "2", "FALSE", "2024-02-03", "2024-01-02", "", "1")], "a string, b string, c string, d string, e string, "
                 "f string, g string, h string")
    assert list(jsonbridge.text_types(data).values()) == [
        "bigint", "double", "string", "boolean", "date", "timestamp_ntz", "string", "string"]
    assert jsonbridge.retype_text(data).first()["g"] is None


def test_row_guard(frame):
    data = frame([(1,), (2,)], "a int")
    assert jsonbridge.assert_max_rows(data, 2) is data
    with pytest.raises(ValueError, match="SQLITE_EXPORT_ROW_LIMIT"):
        jsonbridge.assert_max_rows(data, 1)


def test_delimiter_sniffing(spark, tmp_path):
    (tmp_path / "semi.csv").write_text('a;b\n1;"2,5"\n3;4\n')
    assert tabular.sniff_delimiter(spark.createDataFrame([("a;b",), ('1;"2,5"',), ("3;4",)], "value string")) == ";"
    assert rows(tabular.read_csv(spark, str(tmp_path / "semi.csv"))) == [(1, "2,5"), (3, "4")]


def test_jsonl_positions_span_file_blocks(spark, tmp_path):
    text = "\n".join(["\ufeff" + json.dumps({"n": 0})] + ["" if i % 5 == 0 else json.dumps({"n": i}) for i in range(1, 4000)])
    (tmp_path / "x.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = tabular.json_line_rows(spark, str(tmp_path / "x.jsonl"))
        assert lines.rdd.getNumPartitions() > 1
        got = sorted((r["row_index"], json.loads(r["json"])["n"]) for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [i for i, _ in got] == list(range(len(got)))
    assert [n for _, n in got] == [0] + [i for i in range(1, 4000) if i % 5]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "alpha", "amount": 2}, {"name": "beta", "amount": 7}, "42", 42, null]')
    df = tabular.read_json(spark, str(tmp_path / "a.json"))
    assert df.columns == ["name", "amount", "value", "row_index"]
    assert sorted(rows(df), key=str) == sorted([("alpha", 2, None, None), ("beta", 7, None, None), (None, None, 42, 2),
                                               (None, None, 42, 3), (None, None, None, 4)], key=str)
    (tmp_path / "bad.json").write_text("[{broken")
    with pytest.raises(Exception, match="JSON_INVALID"):
        tabular.read_json(spark, str(tmp_path / "bad.json")).collect()


def test_json_array_files_are_whole(spark, frame, tmp_path):
    data = frame([(1, "ä", 1.0, None), (2, "b\"", 0.5, [1])], "id bigint, s string, x double, a array<int>").repartition(2)
    writers.write_json_array(data, str(tmp_path / "out"))
    found = [r for f in (tmp_path / "out").glob("part-*") for r in json.loads(f.read_text())]
    assert sorted(found, key=str) == sorted([{"id": "1", "s": "ä", "x": 1, "a": None}, {"id": "2", "s": "b\"", "x": 0.5, "a": [1]}], key=str)
    one = next(f.read_text() for f in (tmp_path / "out").glob("part-*") if "ä" in f.read_text())
    assert '\n    "s": "ä",\n    "x": 1,\n    "a": null\n  }' in one


def test_csv_round_trip_with_quotes_and_breaks(spark, frame, tmp_path):
    data = frame([(1, 'a"b,c\nd'), (2, ""), (3, None)], "i int, s string")
    writers.write_csv(data, str(tmp_path / "c"))
    back = tabular.read_csv(spark, str(tmp_path / "c"), ",", schema="i int, s string", multiline=True)
    # an empty cell reads as null, quoted or not
    assert sorted(rows(back)) == [(1, 'a"b,c\nd'), (2, None), (3, None)]


def test_sqlite_scan_ranges_and_views(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.sqlite"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE zeta (x)")
    db.execute("CREATE TABLE data (name TEXT, amount INTEGER, w REAL, b BLOB)")
    db.executemany("INSERT INTO data VALUES (?, ?, ?, ?)", [(f"n{i}", i, i / 2, b"\x01") for i in range(25)])
    db.execute("CREATE VIEW v AS SELECT amount FROM data WHERE amount > 20")
    db.execute("PRAGMA user_version = 7")
    db.commit()
    db.close()
    monkeypatch.setattr("tablemill.sources.sqlite.RANGE_ROWS", 10)
    df = read_sqlite(spark, str(path))
    assert df.dtypes == [("name", "string"), ("amount", "bigint"), ("w", "double"), ("b", "binary")]
    assert df.agg(F.sum("amount"), F.count("name")).first() == (300, 25)
    assert read_sqlite(spark, str(path), "v").count() == 4
    listed = sqlite_catalogue(spark, str(path)).orderBy("type", "name").collect()
    assert [(r["name"], r["type"], r["rows"], r["user_version"]) for r in listed] == [
        ("data", "table", 25, 7), ("zeta", "table", 0, 7), ("v", "view", 4, 7)]


def test_sheet_policy():
    with pytest.raises(ValueError, match="one logical table"):
        workbook.check_sheet_policy("all", "parquet")
    workbook.check_sheet_policy("all", "csv")


def test_header_names_and_gaps(frame):
    cells = frame([("f", "s", 0, r, c, v) for r, c, v in [
        (2, 0, "a"), (2, 1, "a"), (2, 3, "b"), (3, 0, "1"), (3, 3, "2"), (5, 1, "3")]],
        "file string, sheet string, sheet_idx int, row int, col int, value string")
    table = workbook.cells_to_table(cells, ["a", "a_1", "b", "c"]).orderBy("row")
    assert [tuple(r)[3:] for r in table.collect()] == [("1", None, "2", None), (None, "3", None, None)]


def test_sheet_file_names():
    assert writers.sheet_paths(["Main", "a/b:c"], "book", "csv") == ["book.csv", "book-assets-a_b_c.csv"]


def test_validate_json_fixtures(frame):
    docs = frame([(1, '[{"keyword":"a","value":"b"},{"keyword":"c","value":"d"}]'), (2, "[{broken"), (3, "")], "doc_id int, text string")
    found = {r["doc_id"]: r for r in validate.validate_json(docs, lines=False).collect()}
    assert (found[1]["valid"], found[1]["rows"], found[1]["columns"]) == (True, 2, 2)
    assert not found[2]["valid"] and "JSON" in found[2]["error"] and not found[3]["valid"]


def test_quoted_line_breaks_need_no_option(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,"p ""q"""\n')
    assert rows(tabular.read_csv(spark, str(tmp_path / "q.csv"))) == [(1, "x\ny"), (2, 'p "q"')]
    found = validate.validate_dataset(spark, str(tmp_path / "q.csv"), "csv").first()
    assert (found["valid"], found["rows"]) == (True, 2)


def test_a_dataset_must_be_what_it_claims(spark, tmp_path):
    (tmp_path / "j.csv").write_text('[{"a": 1}, {"a": 2}]')
    found = validate.validate_dataset(spark, str(tmp_path / "j.csv"), "csv").first()
    assert not found["valid"] and "json-data" in found["error"]
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert validate.validate_dataset(spark, str(tmp_path / "j.json"), "json-data").first()["valid"]


def test_delimiter_of_late_lines(spark, tmp_path):
    (tmp_path / "late.csv").write_text("title\n" * 100 + "a;b;c\n" * 400)
    assert tabular.sniff_delimiter(spark.read.text(str(tmp_path / "late.csv"))) == ";"


def test_keys_and_types_of_late_rows(spark):
    late = spark.range(12_000).select(F.col("id").alias("row_index"), F.when(
        F.col("id") == 11_999, '{"a": "text", "late": 1.5}').otherwise('{"a": 1}').alias("row_json"))
    assert dict(rows(jsonbridge.infer_affinity(late))) == {"a": "TEXT", "late": "REAL"}


def test_columns_and_types_in_one_pass(frame):
    import json
    import random

    from tablemill.operators import jsonbridge as bridge

    rng = random.Random(1)
    values = [1, 2.5, 1.0, 1e21, 12345678901234567890, "3", "x", "", None, True, "true", "2024-01-02", "2024-01-02T03:04:05", [1], {"a": 1}, "-7", "+1", ".5"]
    keys = ["b", "a", "10", "2", "07", "4294967295", "Ä", "long key"]
    pools = {k: rng.sample(values, rng.randint(1, 3)) for k in keys}
    rows = [(i, json.dumps({k: rng.choice(pools[k]) for k in rng.sample(keys, rng.randint(0, 8))})) for i in range(200)]
    df = frame(rows, "row_index bigint, row_json string").repartition(5)
    columns = bridge.ordered_columns(df)
    assert bridge.infer_columns(df) == {c: t for c, t in bridge.text_types(bridge.rows_to_table(df, columns)).items()}
    assert list(bridge.infer_columns(df)) == columns
    assert bridge.infer_columns(df.where("false")) == {"value": "string"}
    with pytest.raises(ValueError, match="DATA_COLUMN_LIMIT"):
        bridge.infer_columns(df, max_columns=3)


def test_costly_rows_are_spread(spark):
    from tablemill.functions.tables import spread

    packed = spark.range(12_000).coalesce(1)
    dealt = spread(packed)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.agg(F.sum("id"), F.count("id")).first() == packed.agg(F.sum("id"), F.count("id")).first()
    assert spread(packed.limit(0)).count() == 0


def test_workbook_queries_spread_and_decode_once(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    for name in ("i5_sheet_summary", "s8_w2_workbook_table", "i6_workbook_summary", "w3_formula_mode"):
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, name
        assert ("MapInPandas" not in plan) if name == "w3_formula_mode" else ("REPARTITION_BY_NUM" in plan), name


def test_distinct_counts_keep_no_sketch_per_value(spark):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["q6_approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [re.search(r"keys=\[([^\]]*)", line).group(1) for line in plan.splitlines() if "approx_count_distinct(" in line and "keys=" in line]
    assert keys and not any("l_orderkey" in k for k in keys)
