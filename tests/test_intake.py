"""Intake by content over several runs, with renamed, re-delivered, changed and repeated files."""

import os

from tablemill.streaming import by_content
from tablemill.streaming.by_content import intake_by_content


def taken(spark, out):
    return sorted((r.name, r.run) for r in spark.read.option("basePath", out).parquet(out).collect())


def test_files_are_known_by_content(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    os.mkdir(inbox)

    def put(name, text, time=None):
        path = os.path.join(inbox, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
        if time:
            os.utime(path, (time, time))

    put("a.json", '{"a": 1}', 1_700_000_000)
    put("b.csv", "x,y\n1,2\n", 1_700_000_100)
    put("sub/copy.json", '{"a": 1}', 1_700_000_200)
    first = {os.path.basename(r.path): r.status for r in intake_by_content(spark, inbox, out, state).collect()}
    assert first == {"a.json": "new", "b.csv": "new", "copy.json": "known"}
    assert intake_by_content(spark, inbox, out, state).count() == 0

    os.rename(os.path.join(inbox, "b.csv"), os.path.join(inbox, "renamed.csv"))  # an old time under a new name
    put("a.json", '{"a": 2}', 1_700_000_300)  # an old name with another content
    put("again.json", '{"a": 1}', 1_700_000_400)
    put("c.txt", "fresh text", 1_600_000_000)  # older than all others
    second = {os.path.basename(r.path): r.status for r in intake_by_content(spark, inbox, out, state).collect()}
    assert second == {"renamed.csv": "known", "a.json": "changed", "again.json": "known", "c.txt": "new"}
    assert taken(spark, out) == [("a.json", 0), ("a.json", 1), ("b.csv", 0), ("c.txt", 1)]
    formats = {r.name: r.format_id for r in spark.read.parquet(f"{out}/run=1").collect()}
    assert formats["a.json"] == "json-data"


def test_a_run_that_was_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    os.mkdir(inbox)
    (tmp_path / "inbox" / "a.txt").write_text("one")
    intake_by_content(spark, inbox, out, state)
    (tmp_path / "inbox" / "b.txt").write_text("two")
    read = by_content.detect_formats

    def broken(df):
        raise RuntimeError("lost")

    monkeypatch.setattr(by_content, "detect_formats", broken)
    try:
        intake_by_content(spark, inbox, out, state)
    except RuntimeError:
        pass
    monkeypatch.setattr(by_content, "detect_formats", read)
    # what was taken but not noted is taken over by the next run of the same number
    spark.read.parquet(f"{out}/run=0").write.mode("overwrite").parquet(f"{out}/run=1")
    assert [r.status for r in intake_by_content(spark, inbox, out, state).collect()] == ["new"]
    assert taken(spark, out) == [("a.txt", 0), ("b.txt", 1)]
    assert intake_by_content(spark, inbox, out, state).count() == 0
