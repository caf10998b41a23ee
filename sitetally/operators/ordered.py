"""Ordered scans over groups of any size.

A plain window sends a whole group to one task. These helpers sort the rows
into ranges of keys and order once, write them with the number of their range,
work inside the ranges, and carry one summary row per key and range. Ranges
hold about the same number of rows, however the order column is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

RANGE = "_range"


def in_ranges(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df as a written table with ``_range``: ranges follow each other in (keys, order)."""
    return written(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def rank_by_range(df: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``row_number`` per ``keys`` along ``order``, as column ``out``."""
    ranged = in_ranges(df, keys, order)
    numbered = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(RANGE, *keys).orderBy(*order)))
    offsets = (
        ranged.groupBy(RANGE, *keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(RANGE, *keys, F.coalesce(F.sum("_n").over(_before(*keys)), F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(offsets, [RANGE, *keys])
        .withColumn(out, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, out)
    )


def running_count(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Running number per ``keys`` along the unique ``order``."""
    return rank_by_range(df, keys, [order], out)


def carry_forward(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Replace nulls of ``columns`` by the last earlier value of the group."""
    ranged = in_ranges(df, keys, [order])
    inside = (Window.partitionBy(RANGE, *keys).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = ranged.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    last_of_range = ranged.groupBy(RANGE, *keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ])
    carried = last_of_range.select(
        RANGE, *keys,
        *[F.last(c, ignorenulls=True).over(_before(*keys)).alias(f"_carried_{c}") for c in columns],
    )
    return (
        filled.join(carried, [RANGE, *keys])
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_carried_{c}")) for c in columns})
        .select(*df.columns)
    )
