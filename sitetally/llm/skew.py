"""Joins that neither a hot key nor a growing table can break: hot keys go to the rows, bounded bit tables thin out the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on; in large tables from a HOT_KEYS-th of all rows on, so at most HOT_KEYS keys are hot.
HOT_ROWS = 1024
HOT_KEYS = 50_000
#: Bits of a table of marks: 4 MB at any size of the data. With more marks than bits it lets all rows through.
MARK_BITS = 1 << 25


def lookup(rows: DataFrame, counted: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join of rows with a table of one row a key (keys never null) whose column `count` bounds the rows that the key has.

    Hot keys are broadcast, so their rows stay where they are; the others are shuffled. Both tables are read twice: pass written ones.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(HOT_ROWS, -(-total // HOT_KEYS))
    # at most HOT_KEYS rows: each stands for a HOT_KEYS-th of the total or more
    few = F.broadcast(counted.filter(hot))
    cold = rows.join(F.broadcast(counted.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(cold.join(counted.filter(~hot), keys))


def marks(keys: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits): a table of marks with the bit of every key set; at most MARK_BITS bits, whatever the number of keys."""
    place = F.pmod(key, F.lit(MARK_BITS)) + 1
    found = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_mark(rows: DataFrame, key: Column, marked: DataFrame, name: str) -> DataFrame:
    """rows with the boolean `name`: false if the key was surely not marked."""
    place = F.pmod(key, F.lit(MARK_BITS)) + 1
    bit = F.bitmap_bit_position(place)
    # at most MARK_BITS / 32768 rows of 4 KB
    few = F.broadcast(marked.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    byte = F.conv(F.hex(F.substr("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.join(few, F.bitmap_bucket_number(place) == F.col("_bucket"), "left").withColumn(name, set_).drop("_bucket", "_bits")
