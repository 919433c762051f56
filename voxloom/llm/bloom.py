"""Blocked Bloom filters as small tables: a key sets eight bits, one in each 32-bit lane of one block.

A filter is sized from its number of keys and broadcast only up to ``MAX_BLOCKS`` rows; for more keys there is none, and
all rows count as possible.  Whoever uses it must join what passes exactly, so results are the same either way."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

LANES, BITS_PER_KEY = 8, 12
#: Rows of the largest filter that is broadcast: 12 bits a key for about 11 million keys, at most 60 MB.
MAX_BLOCKS = 1 << 19


def block_of(key: Column, blocks: int) -> Column:
    """From the hash's high bits."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 5 * LANES), F.lit(blocks)).cast("int")


def bit_of(key: Column, lane: int) -> Column:
    """From five of the hash's low bits for each lane."""
    place = F.shiftright(F.xxhash64(key), 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def build(keys: DataFrame, key: Column, count: int) -> tuple[DataFrame, int] | None:
    """The filter of ``count`` keys: a row for each block that has bits, and the number of blocks; None if too large."""
    blocks = 1 << max(4, math.ceil(math.log2(max(1, count) * BITS_PER_KEY / (32 * LANES))))
    if blocks > MAX_BLOCKS:
        return None
    bits = keys.select(block_of(key, blocks).alias("__block"), *[bit_of(key, i).alias(f"__b{i}") for i in range(LANES)])
    return bits.groupBy("__block").agg(*[F.bit_or(f"__b{i}").alias(f"__b{i}") for i in range(LANES)]), blocks


def mark(rows: DataFrame, key: Column, filter_: tuple[DataFrame, int] | None, name: str = "__hit") -> DataFrame:
    """``rows`` with a column that is false where the key is certainly not among the filter's; null keys never are."""
    if filter_ is None:
        return rows.withColumn(name, key.isNotNull())
    table, blocks = filter_
    names = rows.columns
    tested = rows.withColumn("__block", F.when(key.isNotNull(), block_of(key, blocks))).join(F.broadcast(table), "__block", "left")  # at most MAX_BLOCKS rows
    hit = F.lit(True)
    for i in range(LANES):
        hit = hit & (F.col(f"__b{i}").bitwiseAND(bit_of(key, i)) != 0)
    return tested.select(*names, F.coalesce(hit, F.lit(False)).alias(name))
