"""Stored sketches: distinct counts, set sizes and quantiles that are merged instead of counted again.

A table of sketches has one row per key (say a day and a country) with a theta sketch per column to count and a KLL sketch per
column to rank, a few KB each. Any coarser grouping, rollup or range of days is a merge of its rows; sets of two rows meet in
intersections and differences. The source is read once.

Errors (one standard deviation): a distinct count is exact up to ``2 ** LG`` values and then off by ``2 ** (-LG / 2)`` of itself; an
intersection or difference by that much of the union; a quantile's rank by about ``2.3 / K``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 14, 800
DISTINCT_ERROR, RANK_ERROR = 2 ** (-LG / 2), 2.3 / K


def sketch_table(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, Column], ranked: Mapping[str, Column]) -> DataFrame:
    """``keys, rows`` and a sketch for each name; nulls are neither counted nor ranked."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.theta_sketch_agg(c, LG).alias(n) for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(c.cast("double"), K).alias(n) for n, c in ranked.items()])


def _merged(distinct: Sequence[str], ranked: Sequence[str]) -> list[Column]:
    return [F.sum("rows").alias("rows"), *[F.theta_union_agg(n, LG).alias(n) for n in distinct],
            *[F.kll_merge_agg_double(n, K).alias(n) for n in ranked]]


def merge_sketches(table: DataFrame, keys: Sequence[str], distinct: Sequence[str], ranked: Sequence[str] = ()) -> DataFrame:
    """The table for fewer keys."""
    return table.groupBy(*keys).agg(*_merged(distinct, ranked))


def rollup_sketches(table: DataFrame, keys: Sequence[str], distinct: Sequence[str], ranked: Sequence[str] = ()) -> DataFrame:
    """The table for every prefix of the keys, with ``level`` as the number of keys that are summed up."""
    return table.rollup(*keys).agg(F.grouping_id().alias("level"), *_merged(distinct, ranked)).withColumn(
        "level", F.bit_count("level"))


def distinct_count(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def quantile(sketch: str, rank: float) -> Column:
    """The value below which about ``rank`` of the values lie; null where there are none."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))


def set_counts(left: Column, right: Column) -> Column:
    """``struct<both, left_only, right_only, either>``: distinct values by the sketches they are in."""
    return F.struct(
        F.theta_sketch_estimate(F.theta_intersection(left, right)).alias("both"),
        F.theta_sketch_estimate(F.theta_difference(left, right)).alias("left_only"),
        F.theta_sketch_estimate(F.theta_difference(right, left)).alias("right_only"),
        F.theta_sketch_estimate(F.theta_union(left, right, LG)).alias("either"))
