"""Consistent-hash ring as tables: build, successor lookup, replica sets, range moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ring_hash


def build(nodes: DataFrame, states=("NORMAL", "LEAVING")) -> DataFrame:
    """node_id, vnode_id and hash of every virtual node of the nodes in `states`."""
    picked = nodes.where(F.col("state").isin(*states)).select("node_id", F.explode(F.sequence(F.lit(0), F.col("virtual_nodes").cast("int") - 1)).alias("i"))
    named = picked.select("node_id", F.concat("node_id", F.lit("-vnode-"), F.col("i").cast("string")).alias("vnode_id"))
    return named.withColumn("hash", ring_hash(F.col("vnode_id")))


def intervals(ring: DataFrame) -> DataFrame:
    """prev of each hash: it owns (prev, hash]. The first follows the last. The ring has as many rows as virtual nodes."""
    order = Window.orderBy("hash", "vnode_id")
    return ring.withColumn("prev", F.coalesce(F.lag("hash").over(order), F.max("hash").over(Window.partitionBy())))


def owners(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """`keys` (with hash) and the virtual node of each: the first at its hash or after it.

    Intervals are dealt by the first byte of the hashes they meet, so this is an equi-join with a residual range; Spark
    broadcasts the ring while it is small and shuffles it beyond.
    """
    own = intervals(ring)
    ends = F.when(F.col("prev") < F.col("hash"), F.array(F.struct(F.col("prev").alias("lo"), F.col("hash").alias("hi")))).otherwise(
        F.array(F.struct(F.col("prev").alias("lo"), F.lit("g").alias("hi")), F.struct(F.lit("").alias("lo"), F.col("hash").alias("hi"))))
    byte = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    cut = own.select("node_id", "vnode_id", F.explode(ends).alias("e")).select("node_id", "vnode_id", "e.lo", "e.hi")
    first, last = F.when(F.col("lo") == "", 0).otherwise(byte(F.col("lo"))), F.when(F.col("hi") == "g", 255).otherwise(byte(F.col("hi")))
    dealt = cut.withColumn("bucket", F.explode(F.sequence(first, last)))
    asked = keys.withColumn("bucket", byte(F.col("hash")))
    return asked.join(dealt, "bucket").where((F.col("hash") > F.col("lo")) & (F.col("hash") <= F.col("hi"))).drop("bucket", "lo", "hi")


def in_ranges(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """`keys` (with hash) with every range (range_id, lo, hi) that has their hash: lo <= hash < hi around the ring; equal ends hold
    nothing. Like owners(), an equi-join on the first byte of the hash; streams may stand on the left."""
    ends = F.when(F.col("lo") < F.col("hi"), F.array(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to")))).when(
        F.col("lo") > F.col("hi"), F.array(F.struct(F.col("lo").alias("from"), F.lit("g").alias("to")), F.struct(F.lit("").alias("from"), F.col("hi").alias("to"))))
    byte = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    cut = ranges.select("range_id", F.explode(ends).alias("e")).select("range_id", F.col("e.from").alias("range_from"), F.col("e.to").alias("range_to"))
    first, last = F.when(F.col("range_from") == "", 0).otherwise(byte(F.col("range_from"))), F.when(F.col("range_to") == "g", 255).otherwise(byte(F.col("range_to")))
    dealt = cut.withColumn("bucket", F.explode(F.sequence(first, last)))
    asked = keys.withColumn("bucket", byte(F.col("hash")))
    return asked.join(dealt, "bucket").where((F.col("hash") >= F.col("range_from")) & (F.col("hash") < F.col("range_to"))).drop("bucket", "range_from", "range_to")


def add(ring: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ring with the virtual nodes of `nodes` (node_id, virtual_nodes) that it lacks."""
    new = build(nodes.withColumn("state", F.lit("NORMAL")))
    return ring.unionByName(new.join(ring.select("vnode_id"), "vnode_id", "left_anti"))


def remove(ring: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ring without the virtual nodes of `nodes` (node_id)."""
    return ring.join(nodes.select("node_id"), "node_id", "left_anti")


def successors(ring: DataFrame, count: int) -> DataFrame:
    """For each virtual node the first `count` distinct nodes clockwise from it, with their rank from 1; all of them where there
    are fewer.

    Each looks at a bounded number of virtual nodes ahead of it, in one sorted pass; the number grows until all have enough. The
    ring has as many rows as virtual nodes, never keys.
    """
    size, nodes = ring.agg(F.count("*"), F.count_distinct("node_id")).first()
    ranked = ring.withColumn("pos", F.row_number().over(Window.orderBy("hash", "vnode_id")))
    look, need = min(size, 8 * count), min(count, nodes)
    while True:
        around = ranked.union(ranked.where(F.col("pos") <= look).withColumn("pos", F.col("pos") + size))
        ahead = F.array_distinct(F.collect_list("node_id").over(Window.orderBy("pos").rowsBetween(0, max(0, look - 1))))
        listed = around.withColumn("ahead", ahead).where(F.col("pos") <= size)
        if look >= size or listed.where(F.size("ahead") < need).isEmpty():
            break
        look = min(size, 4 * look)
    each = listed.select("vnode_id", F.posexplode(F.slice("ahead", 1, count)).alias("at", "replica"))
    return each.select("vnode_id", "replica", (F.col("at") + 1).cast("long").alias("rank"))


def replicas(keys: DataFrame, ring: DataFrame, count: int) -> DataFrame:
    """`keys` with replica and rank, one row for each of the `count` replicas of a key."""
    return owners(keys, ring).drop("node_id").join(successors(ring, count), "vnode_id").drop("vnode_id")


def moved(new: DataFrame, old: DataFrame) -> DataFrame:
    """The ranges (lo, hi] of virtual nodes that `old` lacks, with the node that owned them there."""
    added = intervals(new).join(old.select("vnode_id"), "vnode_id", "left_anti").select(F.col("vnode_id").alias("vnode"), F.col("node_id").alias("to_node"), "prev", "hash")
    return owners(added, old).select("vnode", "to_node", F.col("node_id").alias("from_node"), F.col("prev").alias("lo"), F.col("hash").alias("hi"))


def moves(keys: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """`keys` (with hash) whose owner changes from one ring to another, with from_node and to_node: what a join or a removal copies."""
    after = owners(keys, new).withColumnRenamed("node_id", "to_node").drop("vnode_id")
    return owners(after, old).withColumnRenamed("node_id", "from_node").drop("vnode_id").where("from_node != to_node")


def authoritative(replicas_: DataFrame, nodes: DataFrame) -> DataFrame:
    """`replicas_` (with replica) and whether each counts for a quorum's size: nodes in state NORMAL do."""
    counts = nodes.select(F.col("node_id").alias("replica"), (F.col("state") == "NORMAL").alias("counts"))
    return replicas_.join(counts, "replica", "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
