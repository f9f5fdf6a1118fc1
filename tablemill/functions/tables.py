"""Small fixed tables, rows dealt to tasks, values computed once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import pyarrow as pa


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of fixed number as a table in one partition: joins with it and groupings of it need no shuffle."""
    fields = T._parse_datatype_string(schema)

    def plain(value, dtype):
        if isinstance(dtype, T.ArrayType):
            return [plain(v, dtype.elementType) for v in value]
        if isinstance(dtype, T.StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(dtype.fields, value)}
        return value

    table = pa.Table.from_pylist([plain(row, fields) for row in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, schema=fields).coalesce(1)


def spread(df: DataFrame, rows: int = 5_000) -> DataFrame:
    """The rows dealt evenly to tasks of about ``rows``, for costly work on each: a compact file is else read by one task."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    Filters and projections that come later are usually pushed below a projection by repeating its expressions, which
    multiplies large ones. They stop at a generator, so the values leave through one (of exactly one row).
    """
    values = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, for use inside lambdas, where repeats are not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
