"""Scans in an order: running totals without one task over all rows, pages, key listings, share estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import range_share


def running(df: DataFrame, order: str, ties: tuple[str, ...] = (), weight: Column | None = None, name: str = "before") -> DataFrame:
    """`df` with the total weight (1 a row if not given) of the rows before each in the order of `order` and `ties`.

    Rows are dealt into ranges of `order`, whose ends come from a bounded sample by hash; a window in each range and the totals of
    the ranges (a row each) give the running total. The result does not depend on the sample.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1) if weight is None else weight
    sample = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(32 * n).collect())
    ends = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    kind = dict(df.dtypes)[order]
    at = F.size(F.filter(F.array(*map(F.lit, ends)).cast(f"array<{kind}>"), lambda e: e <= F.col(order))) if ends else F.lit(0)
    dealt = df.withColumn("range_no", F.coalesce(at, F.lit(0))).withColumn("own_weight", weight.cast("long"))
    totals = dealt.groupBy("range_no").agg(F.sum("own_weight").alias("total"))
    start = totals.select("range_no", (F.sum("total").over(Window.orderBy("range_no")) - F.col("total")).alias("start"))
    within = F.sum("own_weight").over(Window.partitionBy("range_no").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)) - F.col("own_weight")
    return dealt.withColumn(name, within).join(F.broadcast(start), "range_no").withColumn(name, (F.col(name) + F.col("start")).cast("long")).drop("range_no", "own_weight", "start")


def page(live: DataFrame, tenant: str, first: str, last: str, most: int = 1000) -> DataFrame:
    """At most `most` keys of a tenant from `first` to `last` in order; has_more, and next_key, where the next page begins."""
    found = live.where((F.col("tenant_id") == tenant) & F.col("key").between(first, last)).select("key").orderBy("key").limit(most + 1)
    order = Window.orderBy("key")  # a page and one row
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("next_key", F.max(F.when(F.col("rank") > most, F.col("key"))).over(Window.partitionBy()))
    return ranked.where(F.col("rank") <= most).select("key", F.col("next_key").isNotNull().alias("has_more"), "next_key")


def key_listing(files: DataFrame) -> DataFrame:
    """Every composite key of some files once; in no order."""
    return files.select(F.concat("tenant_id", F.lit(":"), "key").alias("composite_key")).distinct()


def range_estimates(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that each range (lo, hi) of the ring may have, by its share of all keys."""
    total = keys.agg(F.count("*").alias("total"))
    return ranges.join(F.broadcast(total)).select("range_id", F.floor(F.col("total") * range_share(F.col("lo"), F.col("hi"))).cast("long").alias("keys"))


def append(log: DataFrame, writes: DataFrame, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """`writes` with the sequence numbers (seq) that follow the log's last one, in the order of `order` and `ties`."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return running(writes, order, ties, name="place").join(F.broadcast(last)).withColumn("seq", F.col("last") + 1 + F.col("place")).drop("last", "place")


def digests(rows: DataFrame, by: list[str], content: Column) -> DataFrame:
    """A digest of the rows of each group that their order does not change: their number and the sum of 32 bits of each row's MD5.

    Sums are made before the shuffle, so a group of any size is a row a task.
    """
    part = F.conv(F.substring(F.md5(content.cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part).alias("digest"))
