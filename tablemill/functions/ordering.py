"""Running values and ordered text without one task per group.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task. These helpers cut every key into
bounded ranges of the order column first: a window runs inside each range, and one small row per range carries
the totals across. A key that holds a third of all rows is so spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000


def int_range(order: str, rows: int = RANGE_ROWS) -> Column:
    """Range number of an integer order column; unique integers put at most ``rows`` rows into a range."""
    return F.floor(F.col(order) / F.lit(rows)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    bucket: Column,
) -> DataFrame:
    """Add inclusive running values per ``keys`` in ``order``.

    ``values`` maps a new column to ``(kind, expression)`` with kind ``sum``, ``min``, ``max`` or ``last`` (last
    non-null). ``bucket`` must not decrease along ``order``. Keys must not be null.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    part = [*keys, "__range"]
    staged = df.withColumn("__range", bucket)
    for name, (_, expr) in values.items():
        staged = staged.withColumn(f"__v_{name}", expr)

    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.select(
        *df.columns, "__range", *[fold[kind](f"__v_{name}").over(inside).alias(f"__in_{name}")
                                  for name, (kind, _) in values.items()])

    def head(name: str, kind: str) -> Column:
        if kind == "last":
            value = F.col(f"__v_{name}")
            return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("v"))))["v"].alias(f"__h_{name}")
        return fold[kind](f"__v_{name}").alias(f"__h_{name}")

    heads = staged.groupBy(*part).agg(*[head(name, kind) for name, (kind, _) in values.items()])
    across = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(
        *part, *[fold[kind](f"__h_{name}").over(across).alias(f"__carry_{name}") for name, (kind, _) in values.items()])

    joined = local.join(carry, part, "left")
    out = []
    for name, (kind, _) in values.items():
        here, before = F.col(f"__in_{name}"), F.col(f"__carry_{name}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif kind == "last":
            value = F.coalesce(here, before)
        else:
            value = (F.least if kind == "min" else F.greatest)(here, before)
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def running_index(
    df: DataFrame, keys: Sequence[str], order: str, name: str, rows: int = RANGE_ROWS, start: int = 0
) -> DataFrame:
    """Dense position along a unique integer ``order`` column, per ``keys`` (or over the whole table)."""
    out = running(df, keys, [order], {name: ("sum", F.lit(1).cast("bigint"))}, int_range(order, rows))
    return out.withColumn(name, F.col(name) + F.lit(start - 1))


def ordered_parts(
    df: DataFrame, keys: Sequence[str], order: str, text: Column, separator: str, rows: int = 10_000
) -> DataFrame:
    """Join ``text`` along a unique integer ``order`` (from 0 or 1 up) into parts of at most ``rows`` pieces.

    Rows ``(keys, part, text)``; the parts of a key in ``part`` order, put together, are the whole text.
    """
    piece = F.struct(F.col(order).alias("o"), text.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), separator)
    grouped = df.groupBy(*keys, int_range(order, rows).alias("part")).agg(joined.alias("text"))
    return grouped.withColumn("text", F.when(F.col("part") > 0, F.concat(F.lit(separator), "text")).otherwise(F.col("text")))
