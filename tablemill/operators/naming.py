"""Output names: templates, and names made unique in input order at any scale."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.ordering import RANGE_ROWS, int_range, running, running_index
from tablemill.functions.tables import once
from tablemill.functions.text import JS_SPACE
from tablemill.session import shared_dir

DEFAULT_TEMPLATE = "{name}-converted"
TOKEN = re.compile(r"\{(name|sourceExt|ext|format|index|total|date)(?::(\d{1,3}))?\}")
MAX_NAME = 180


def _base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def sanitize_name(col: Column, max_chars: int = MAX_NAME) -> Column:
    """Unsafe characters to ``_``, white space collapsed, outer dots and blanks off, at most ``max_chars`` characters."""
    out = F.regexp_replace(col, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, f"{JS_SPACE}+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"^[. ]+", ""), r"[. ]+$", "")
    out = F.substring(out, 1, max_chars)
    return F.when(out == "", "output").otherwise(out)


def render_names(
    df: DataFrame, template: str, target_ext: str, target_format: str, date: str,
    source: str = "source_name", index: str = "idx", total: str | Column = "total", out: str = "output_name",
) -> DataFrame:
    """Add the output name by ``template``; ``index`` is 0-based, ``date`` is ``yyyy-MM-dd``."""
    ext = target_ext.removeprefix(".")
    base = _base_name(F.col(source))
    number = (F.col(index) + 1).cast("string")
    tokens = {
        "name": F.regexp_replace(base, r"(?s)^(.+)\.[^.]*$", "$1"),
        "sourceExt": F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1),
        "ext": F.lit(ext),
        "format": F.lit(target_format),
        "index": number,
        "total": (F.col(total) if isinstance(total, str) else total).cast("string"),
        "date": F.lit(date),
    }
    text, pieces, at = template.strip() or DEFAULT_TEMPLATE, [], 0
    for match in TOKEN.finditer(text):
        pieces.append(F.lit(text[at:match.start()]))
        piece = tokens[match[1]]
        if match[2] and match[1] == "index":
            width = min(6, max(1, int(match[2])))
            piece = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
        pieces.append(piece)
        at = match.end()
    name = sanitize_name(F.concat(*pieces, F.lit(text[at:])))
    if ext:
        name = F.when(F.lower(name).endswith("." + ext.lower()), name).otherwise(F.concat(name, F.lit("." + ext)))
    return once(df.drop(out), **{out: name})


@dataclass(frozen=True)
class SuffixStyle:
    """How a repeat is named: ``(directory, stem, extension)`` of a name, and the text of suffix ``n``."""

    directory: Callable[[Column], Column]
    suffix: Callable[[Column], Column]
    numbered: str  # stem pattern: group 1 the stem without suffix, group 2 its number


def _no_directory(col: Column) -> Column:
    return F.substring(col, 1, 0)


DASH = SuffixStyle(_no_directory, lambda n: F.concat(F.lit("-"), n), r"(?s)^(.+)-([2-9]|[1-9]\d{1,17})$")
PARENTHESES = SuffixStyle(
    lambda c: F.regexp_extract(c, r"(?s)^(.*/)", 1), lambda n: F.concat(F.lit(" ("), n, F.lit(")")),
    r"(?s)^(.+) \(([2-9]|[1-9]\d{1,17})\)$")


def _split(col: Column, style: SuffixStyle) -> tuple[Column, Column, Column]:
    directory = style.directory(col)
    file = F.substring(col, F.length(directory) + 1, F.length(col))
    extension = F.regexp_extract(file, r"(?s)^.+(\.[^.]*)$", 1)
    stem = F.substring(file, F.lit(1), F.length(file) - F.length(extension))
    return directory, stem, extension


def _unique(df: DataFrame, name: str, order: str, style: SuffixStyle, out: str) -> DataFrame:
    """Names in ``order``: the first of a (case-folded) name keeps it, each repeat takes the next free number.

    A repeat number can meet a real name of the same form (``x-2`` before or after the repeats of ``x``), so a
    plain rank is not enough. Only such *contested* names need more, and for them one row per distinct name is
    enough: the number of earlier ``x`` rows tells whether the real ``x-N`` came first (the repeats skip N) or late
    (it is itself renamed). The number of skips is settled by rounds of prefix sums, all of them spread over tasks.
    """
    spark = df.sparkSession
    rows = running_index(df.withColumn("__l", F.lower(F.col(name))), ["__l"], order, "__m", start=1)

    names = df.groupBy(F.lower(F.col(name)).alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    directory, stem, extension = _split(F.col("l"), style)
    split = once(names, dir=directory, stem=stem, ext=extension)
    parsed = once(
        split.select("l", "n", "first", "dir", "stem", "ext"),
        number=F.regexp_extract("stem", style.numbered, 2),
        parent=F.concat("dir", F.regexp_extract("stem", style.numbered, 1), "ext"))
    children = parsed.where(F.col("number") != "").select(
        "parent", F.col("l").alias("child"), F.col("number").cast("bigint").alias("number"), "first")
    parents = names.select(F.col("l").alias("parent"), F.col("n").alias("parent_rows"))
    contested = children.join(parents, "parent")
    # a number beyond all rows of the parent plus all numbers that could be skipped is never asked for
    width = contested.groupBy("parent").agg(F.count(F.lit(1)).alias("numbers"))
    contested = contested.join(width, "parent").where(
        F.col("number") <= F.col("parent_rows") + F.col("numbers") + 1).drop("numbers")
    shared_dir(spark)
    contested = contested.checkpoint()
    if contested.isEmpty():
        return _rename(rows, name, style, F.col("__m"), F.col("__m") > 1, out).drop("__l", "__m")

    displaced = spark.createDataFrame([], "l string")
    skips = spark.createDataFrame([], "l string, m bigint, skipped bigint")
    # parents before children: a name that is no contested child is settled first
    settled = contested.select(F.col("parent").alias("l")).distinct().join(
        contested.select(F.col("child").alias("l")), "l", "left_anti")
    while not settled.isEmpty():
        level = contested.join(settled.select(F.col("l").alias("parent")), "parent", "left_semi").join(
            displaced.select(F.col("l").alias("parent"), F.lit(1).alias("d")), "parent", "left").select(
            "parent", "child", "number", "first", "parent_rows", F.coalesce("d", F.lit(0)).alias("d"))
        level = _settle(df, level, name, order).checkpoint()
        hit = level.where("skip").groupBy(F.col("parent").alias("l"), "m").agg(F.count(F.lit(1)).alias("skipped"))
        skips = skips.unionByName(hit).checkpoint()
        displaced = displaced.union(level.where("late").select("child")).checkpoint()
        settled = level.select(F.col("child").alias("l")).join(
            contested.select(F.col("parent").alias("l")).distinct(), "l", "left_semi").checkpoint()

    marked = rows.join(displaced.select(F.col("l").alias("__l"), F.lit(1).alias("__d")), "__l", "left").withColumn(
        "__d", F.coalesce("__d", F.lit(0)))
    skip_rows = skips.select(F.col("l").alias("__l"), F.col("m").alias("__m"), F.col("skipped").alias("__s"))
    hot = marked.join(skip_rows.select("__l").distinct(), "__l", "left_semi")
    calm = marked.join(skip_rows.select("__l").distinct(), "__l", "left_anti").withColumn("__k", F.lit(0).cast("bigint"))
    both = hot.withColumn("__s", F.lit(0).cast("bigint")).withColumn("__row", F.lit(1)).unionByName(
        skip_rows.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    shifted = running(both, ["__l"], ["__m", "__row"], {"__k": ("sum", F.col("__s"))}, int_range("__m")).where(
        "__row = 1").drop("__s", "__row")
    final = calm.unionByName(shifted)
    number = F.col("__m") + F.col("__d") + F.col("__k")
    return _rename(final, name, style, number, F.col("__m") + F.col("__d") > 1, out).drop("__l", "__m", "__d", "__k")


def _settle(df: DataFrame, level: DataFrame, name: str, order: str) -> DataFrame:
    """Decide for every contested child whether the repeats of its parent skip its number or take its name."""
    rows = df.select(F.lower(F.col(name)).alias("parent"), F.col(order).alias("o"), F.lit(1).cast("bigint").alias("w"))
    rows = rows.join(level.select("parent").distinct(), "parent", "left_semi")
    events = level.select("parent", F.col("first").alias("o"), F.lit(0).cast("bigint").alias("w"), "child")
    before = running(rows.unionByName(events, allowMissingColumns=True), ["parent"], ["o", "w"],
                     {"before": ("sum", F.col("w"))}, int_range("o")).where(F.col("child").isNotNull())
    state = level.join(before.select("child", "before"), "child").withColumn("k", F.lit(0).cast("bigint")).checkpoint()
    # m: which row of the parent would ask for this number after k earlier skips
    m = F.col("number") - F.col("d") - F.col("k")
    asked = m <= F.col("parent_rows")
    while True:
        tested = state.withColumn("m", m).withColumn("skip", asked & (F.col("before") < m))
        summed = running(tested, ["parent"], ["number"], {"upto": ("sum", F.col("skip").cast("bigint"))},
                         int_range("number"))
        following = summed.withColumn("k2", F.col("upto") - F.col("skip").cast("bigint")).checkpoint()
        if following.where("k <> k2").isEmpty():
            return following.withColumn("late", asked & ~F.col("skip"))
        state = following.withColumn("k", F.col("k2")).drop("m", "skip", "upto", "k2")


def _rename(rows: DataFrame, name: str, style: SuffixStyle, number: Column, repeat: Column, out: str) -> DataFrame:
    directory, stem, extension = _split(F.col(name), style)
    fresh = F.concat(directory, stem, style.suffix(number.cast("string")), extension)
    return rows.withColumn(out, F.when(repeat, fresh).otherwise(F.col(name)))


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Case-insensitively unique names: ``a.png, A-2.png, a-3.png`` in the order of a unique integer column."""
    return _unique(df, name, order, DASH, out)


def unique_archive_paths(df: DataFrame, path: str, order: str, out: str = "unique_path") -> DataFrame:
    """The same with the archive style ``dir/stem (2).ext``."""
    return _unique(df, path, order, PARENTHESES, out)


def numbered_repeats(df: DataFrame, keys: list[str], path: str, order: str, out: str = "name") -> DataFrame:
    """Extraction names: the second ``a.txt`` of the same archive becomes ``a.txt.2``."""
    ranked = running_index(df, [*keys, path], order, "__m", RANGE_ROWS, start=1)
    return ranked.withColumn(out, F.when(F.col("__m") == 1, F.col(path)).otherwise(
        F.concat(F.col(path), F.lit("."), F.col("__m").cast("string")))).drop("__m")
