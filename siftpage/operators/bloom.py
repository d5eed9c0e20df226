"""Bloom filters as a table: one row of eight words for each block of a bucket.

A value's bits lie in one block, one bit in each of the block's eight words, so that building is a
``bit_or`` merged before the shuffle and a test is an equi-join with one narrow row. Buckets and blocks
are hash values: neither grows hot. At ``PER_BLOCK`` values a block about one of 1,700 absent values
passes; a value that is present always does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, PER_BLOCK = 8, 32
BITS = tuple(f"w{j}" for j in range(WORDS))


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def blocks_for(rows: Column | int) -> Column:
    """How many blocks a bucket of so many rows gets."""
    return F.greatest(F.lit(1), F.ceil(F.lit(rows) / PER_BLOCK)).cast("bigint")


def block_of(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), value), blocks)


def masks(value: Column) -> list[Column]:
    """The bit of each word: six bits of the hash say which."""
    bits = F.xxhash64(F.lit(2), value)
    place = [F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in place]


def bloom_rows(values: DataFrame, value: str, sizes: DataFrame) -> DataFrame:
    """bucket, block and eight words. values: bucket and the value; sizes: bucket, blocks."""
    placed = values.join(sizes, "bucket").withColumn("block", block_of(F.col(value), F.col("blocks")))
    return placed.groupBy("bucket", "block").agg(*(F.bit_or(m).alias(w) for w, m in zip(BITS, masks(F.col(value)), strict=True)))


def possible(rows: DataFrame, value: str, blooms: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """rows with ``_possible``: false only for values that are in no filter.

    sizes has one row for each bucket, so it is small; where a bucket or block is missing it holds nothing.
    """
    own = rows.columns
    keyed = rows.withColumn("_bucket", bucket_of(F.col(value), buckets))
    named = sizes.select(F.col("bucket").alias("_of"), F.col("blocks").alias("_blocks"))
    placed = keyed.join(named, keyed["_bucket"] == named["_of"], "left").withColumn("_block", block_of(F.col(value), F.col("_blocks")))
    words = blooms.select(F.col("bucket").alias("_b"), F.col("block").alias("_k"), *(F.col(w).alias(f"_{w}") for w in BITS))
    joined = placed.join(words, (placed["_bucket"] == words["_b"]) & (placed["_block"] == words["_k"]), "left")
    seen = F.lit(True)
    for w, m in zip(BITS, masks(F.col(value)), strict=True):
        seen = seen & (F.col(f"_{w}").bitwiseAND(m) != 0)
    return joined.select(*own, F.coalesce(seen, F.lit(False)).alias("_possible"))
