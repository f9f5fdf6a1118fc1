"""CSV files with line breaks in cells, read by many tasks, against the reader that takes a file as a whole."""

import random
from collections import Counter

import pytest

from tablemill.sources import csvrecords, tabular
from tablemill.sources.tabular import read_csv

CELLS = ["", "a", "12", '"q"', '"two ""quotes"""', '"line\nbreak"', '"a,b\n\nc,""\nd"', 'inner"quote', '""', '"\n"', '"x"y', " pad "]


@pytest.fixture()
def small_blocks(spark):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def whole(spark, path, header, **options):
    return spark.read.options(header=header, multiLine=True, quote='"', escape='"', **options).csv(path)


@pytest.mark.parametrize("seed", range(5))
def test_records_equal_the_whole_file_reader(spark, small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    end = ["\n", "\r\n"][seed % 2]
    for f in range(2):
        rows = [",".join(rng.choice(CELLS) for _ in range(3)) for _ in range(rng.choice([30, 80]))]
        if seed == 4:
            rows.insert(9, ",".join(['"' + "long\n" * 500 + '"'] * 2))  # one cell over many blocks
        text = end.join(["h1,\"h\n2\",h3", *rows, ""])
        (tmp_path / f"{f}.csv").write_bytes(text.replace("\n", end).replace("\r\r", "\r").encode())
    for header in (True, False):
        schema = "x string, y string, z string"
        want = Counter(map(tuple, whole(spark, str(tmp_path), header).toDF("x", "y", "z").collect()))
        lines = csvrecords.csv_lines(spark, str(tmp_path), ",")
        assert csvrecords.line_blocks(lines).count() > 4
        got = Counter(map(tuple, read_csv(spark, str(tmp_path), ",", header, schema).collect()))
        assert got == want


def test_types_names_and_files_without_breaks(spark, small_blocks, tmp_path):
    rows = "".join(f'{i},"say\n{i}",2024-01-{i % 28 + 1:02d},{i}.5\n' for i in range(60))
    (tmp_path / "a.csv").write_text("id,text,day,x\n" + rows)
    (tmp_path / "b.csv").write_text("id,text,day,x\n7,plain,2024-02-02,1\nid,text,,\n")
    table = read_csv(spark, [str(tmp_path / "a.csv")])
    assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [
        ("id", "bigint"), ("text", "string"), ("day", "date"), ("x", "double")]
    assert table.count() == 60 and table.where("text = 'say\n7'").first().x == 7.5
    both = read_csv(spark, str(tmp_path), ",")
    # a row that repeats the header is a row
    assert both.count() == 62 and both.where("id = 'id'").count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("k,v\n" + "\n".join(f'{i},"x,{i}"' for i in range(50)))
    assert read_csv(spark, str(tmp_path / "c")).where("v = 'x,' || k").count() == 50


def test_unclosed_and_empty(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,"open\n2,3\n' + "4,5\n" * 60)
    assert read_csv(spark, str(tmp_path / "a.csv"), ",").count() == 1
    (tmp_path / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "e.csv"), ",", schema="h string").count() == 0


def test_work_is_spread(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("h,i\n" + '1,"two\nlines"\n' * 2000)
    lines = csvrecords.csv_lines(spark, str(tmp_path), ",")
    blocks = csvrecords.line_blocks(lines)
    assert lines.rdd.getNumPartitions() > 50 and blocks.count() > 50
    records = csvrecords.csv_records(lines, blocks)
    assert records.count() == 2001 and records.where("record like '%\n%'").count() == 2000


def test_places_and_corpus_runs_over_breaks(spark, small_blocks, tmp_path):
    from tablemill.plans.run import run_corpus

    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    for name in ("a", "b"):
        (inbox / f"{name}.csv").write_text("id,text\n" + "".join(f'{i},"{name}\n{i}"\n' for i in range(120)))
    placed = read_csv(spark, str(inbox), ",", place=True)
    assert placed.columns == ["id", "text", "__path", "__block", "__row"]
    for name in ("a", "b"):
        got = placed.where(f"__path like '%/{name}.csv'").orderBy("__block", "__row").collect()
        assert [(r.id, r.text) for r in got] == [(i, f"{name}\n{i}") for i in range(120)]
    report = run_corpus(spark, str(inbox), "parquet", str(out), {"template": "{name}"}).collect()
    assert [(r.state, r.rows) for r in report] == [("completed", 120)] * 2
    back = spark.read.parquet(str(out))
    assert back.count() == 240 and back.where("text = 'b\n7'").count() == 1


def test_no_pass_for_open_cells_without_quotes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabular, "line_blocks", lambda lines: pytest.fail("a pass too many"))
    (tmp_path / "a.csv").write_text("a;b\n1;x\n2;y,z\n")
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y,z")]
