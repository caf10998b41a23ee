"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window group numbers at least; large tables use at most BLOCKS groups of hot keys.
BLOCK_ROWS = 1024
BLOCKS = 50_000


def number_within(df: DataFrame, keys: list[str], order: Column, ties: list[str], name: str, block_rows: int | None = None) -> DataFrame:
    """df with `name`: the row's place, from 0, among the rows of its keys, by `order` (a uniform 64-bit hash), then ties.

    A key with more than block_rows rows is cut into blocks of equal ranges of the hash. Each block is numbered by itself
    and starts at the number of rows in the blocks before it, so no task takes a whole key. Null keys form a group.
    df is read three times: pass a written table or a cheap plan.
    """
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, -(-df.count() // BLOCKS))
    counts = df.groupBy(*keys).count().filter(F.col("count") > block_rows)
    large = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.ceil(F.col("count") / block_rows).cast("long").alias("_blocks"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # at most BLOCKS rows: a table of n rows has no more than n / block_rows keys above block_rows
    dealt = df.withColumn("_hash", order).join(F.broadcast(large), same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    share = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    dealt = dealt.withColumn("_block", F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.floor(share * F.col("_blocks")))).drop("_blocks")
    sizes = dealt.join(F.broadcast(large.drop("_blocks")), same, "left_semi").groupBy(*keys, "_block").count()
    before = sizes.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"),
        F.sum("count").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_hash", *ties)))
    place = (F.coalesce("_before", F.lit(0)) + F.col("_n") - 1).cast("long")
    # at most 2 * BLOCKS rows: a block for every block_rows rows of a large key, and one more
    joined = numbered.join(F.broadcast(before), same & (F.col("_block") == F.col("_b")), "left")
    return joined.withColumn(name, place).select(*df.columns, name)
