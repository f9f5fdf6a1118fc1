"""Proof that a written dataset holds the rows of its source, whatever their order.

Every row becomes two hashes of 64 bits; their sums over all rows do not depend on order or on how rows are spread, and count
repeats. A row that is lost, doubled or changed leaves the sums as they were with a chance of about 2 ** -128. Each side is one
pass that keeps a few numbers per task. Sums of single columns tell where a difference lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(field: T.StructField) -> Column:
    """A value as text that is the same for equal values of either side; whole numbers of any width are alike."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(col)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (col.cast("double") + F.lit(0.0)).cast("string")  # one zero
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("string")
    return col.cast("string")


def _hash(salt: int, cells: Sequence[Column]) -> Column:
    # nulls leave a hash as it is, so each cell says whether it is one
    return F.xxhash64(F.lit(salt), *[part for c in cells for part in (c, c.isNull())])


def _sum(hashed: Column) -> Column:
    return F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``first`` and ``second`` for whole rows, and ``by_column`` (name to sum)."""
    names = sorted(columns or df.columns)
    cells = {f.name: _plain(f) for f in df.schema.fields if f.name in names}
    whole = [cells[n] for n in names]
    return df.agg(
        F.count(F.lit(1)).alias("rows"), _sum(_hash(1, whole)).alias("first"), _sum(_hash(0x5DEECE66D, whole[::-1])).alias("second"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[_sum(_hash(3, [cells[n]])) for n in names])).alias("by_column"))


def compare_rows(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row ``(equal, source_rows, output_rows, different)``; ``different`` names the columns whose values are not the same.

    Columns are matched by name. Equal columns with unequal rows mean that values moved from one row to another.
    """
    names = sorted(set(source.columns) & set(output.columns))
    odd = sorted(set(source.columns) ^ set(output.columns))
    a = checksum(source, names).select(*[F.col(c).alias(f"{c}_a") for c in ("rows", "first", "second", "by_column")])
    b = checksum(output, names).select(*[F.col(c).alias(f"{c}_b") for c in ("rows", "first", "second", "by_column")])
    both = a.join(b)  # one row on either side
    same = (F.col("rows_a") == F.col("rows_b")) & (F.col("first_a") == F.col("first_b")) & (F.col("second_a") == F.col("second_b"))
    changed = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.col("by_column_a")[n] != F.col("by_column_b")[n])
    return both.select(
        (same & F.lit(not odd)).alias("equal"), F.col("rows_a").alias("source_rows"), F.col("rows_b").alias("output_rows"),
        F.array_sort(F.concat(changed, F.array(*[F.lit(n) for n in odd]).cast("array<string>"))).alias("different"))
