"""Large JSON arrays cut by many tasks, against the reader that takes a document as a whole."""

import json
import random

import pytest

from tablemill.sources.jsonparts import array_elements
from tablemill.sources.tabular import json_document_rows, read_json


@pytest.fixture()
def small_blocks(spark):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind < 3:
        return rng.choice(["", "a,b", 'q"uo"te', "]}[{", "\\", "back\\\\,", "Ünïcode ☂", "line\nbreak", "x" * rng.randint(0, 60), "\\\""])
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == 7:
        return {rng.choice(["k", "a,b", "]", '"', "z"]) + str(i): made(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return rng.choice([None, True, 0, -12, 3.5, 1e30])


@pytest.mark.parametrize("size", [64, 301])
def test_elements_equal_the_whole_document_reader(spark, small_blocks, tmp_path, size):
    rng = random.Random(size)
    small_blocks(size)
    for f, style in enumerate([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}]):
        text = json.dumps([made(rng) for _ in range(25)], **style)
        (tmp_path / f"{f}.json").write_text(("﻿ \n" if f == 1 else "") + text + "\n " * f, encoding="utf-8")
    others = {"empty": "[]", "blank": " [ \n ] ", "one": '[{"a": "b,c"}]', "value": '{"a": [1, 2, {"b": "],["}]}', "text": '"a,b"',
              "broken": '[{"a": 1}, {"b": ]', "two": "[1, 2], [3, 4]", "tail": "[1, 2] x", "bad": "[1, 2, x, 3]", "open": '[1, "a, b',
              "gap": "[1,, 2]", "deep": '[1, 2]]', "long": json.dumps(["y, " * 300, 1])}
    for name, text in others.items():
        (tmp_path / f"{name}.json").write_text(text)
    want = sorted(map(tuple, json_document_rows(spark, str(tmp_path)).collect()))
    got = sorted(map(tuple, json_document_rows(spark, str(tmp_path), 0).collect()))
    assert len(want) > 100 and got == want
    assert sorted(map(tuple, json_document_rows(spark, str(tmp_path), 200).collect())) == want


def test_one_document_is_read_by_many_tasks(spark, small_blocks, tmp_path):
    small_blocks(2000)
    rows = [{"id": i, "name": f"n{i}, \"x\"", "tags": [i, {"a": []}]} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    cut = array_elements(spark, str(tmp_path), 0)
    per_block = [r["count"] for r in cut.groupBy("block").count().collect()]
    assert len(per_block) > 40 and max(per_block) < 100
    table = read_json(spark, str(tmp_path))
    assert table.count() == 2000 and table.columns == ["id", "name", "tags"]


def test_no_piece_or_element_inside_a_block_is_shuffled(spark, small_blocks, tmp_path):
    small_blocks(20_000)
    texts = ["a, \"b\" \\\\, " * 20 + str(i) for i in range(800)]
    (tmp_path / "a.json").write_text(json.dumps(texts))
    rows = json_document_rows(spark, str(tmp_path), 0)
    assert [r.json for r in rows.orderBy("row_index").collect()] == list(map(json.dumps, texts))
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
