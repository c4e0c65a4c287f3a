"""Bloom filters as tables of 64-bit words: build, test, and the size for a rate of false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import bloom_size


def bits(key: Column, size: int, hashes: int) -> Column:
    """The bits of a key: two hashes, added up `hashes` times around the filter."""
    a, b = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size)) for seed in (1, 2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + b * i, F.lit(size)))


def build(keys: DataFrame, key: str, expected: int, rate: float = 0.01) -> DataFrame:
    """word and bits: the filter's words that are not 0. Bits are or-ed before the shuffle."""
    size, hashes = bloom_size(expected, rate)
    each = keys.select(F.explode(bits(F.col(key), size, hashes)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    return each.select(F.floor(F.col("bit") / 64).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def might_contain(rows: DataFrame, key: str, filter_: DataFrame, expected: int, rate: float = 0.01) -> DataFrame:
    """`rows` that the filter may have: none of its keys is left out, and about `rate` of others stay. `key` is unique in rows."""
    size, hashes = bloom_size(expected, rate)
    asked = rows.select(key, F.explode(bits(F.col(key), size, hashes)).alias("bit")).select(key, F.floor(F.col("bit") / 64).alias("word"), F.pmod("bit", F.lit(64)).cast("int").alias("at"))
    hit = asked.join(filter_, "word").where(F.call_function("shiftright", F.col("bits"), F.col("at")).bitwiseAND(F.lit(1)) == 1)
    held = hit.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == hashes).select(key)
    return rows.join(held, key, "left_semi")
