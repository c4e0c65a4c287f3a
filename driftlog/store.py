"""The verbs of the store as functions over tables: put, delete, get, scans, compaction, replicas, quorum reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import composite_key, in_range, ring_hash, write_error
from .operators import requests, ring, scans, versions


def put(log: DataFrame, writes: DataFrame, op: str = "write") -> DataFrame:
    """`log` with the valid rows of `writes` (seq, tenant_id, key, value, ts) behind it."""
    good = writes.where(write_error(F.col("tenant_id"), F.col("key"), F.col("value")).isNull())
    return log.unionByName(good.withColumn("op", F.lit(op)).withColumn("is_tombstone", F.lit(op == "delete")), allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """`log` with a tombstone for each of `keys` (seq, tenant_id, key, ts)."""
    return put(log, keys.withColumn("value", F.lit(None).cast("string")), "delete")


def get(log: DataFrame, tenant: str, key: str) -> DataFrame:
    """The live version of a key; the filter reaches the scan."""
    return versions.live(log.where((F.col("tenant_id") == tenant) & (F.col("key") == key)))


def scan_range(log: DataFrame, tenant: str, first: str, last: str, limit: int = 1000) -> DataFrame:
    """A page of live keys from `first` to `last`, in order."""
    return versions.live(log.where((F.col("tenant_id") == tenant) & F.col("key").between(first, last))).orderBy("key").limit(limit)


def scan_hash_range(log: DataFrame, lo: str, hi: str) -> DataFrame:
    return log.where(in_range(ring_hash(composite_key(F.col("tenant_id"), F.col("key"))), F.lit(lo), F.lit(hi)))


def repair(log: DataFrame, writes: DataFrame) -> DataFrame:
    """`log` with the rows of `writes` as repairs, which are taken as they are."""
    return log.unionByName(writes.withColumn("op", F.lit("repair")).withColumn("is_tombstone", F.lit(False)), allowMissingColumns=True)


compact = versions.compact
merge = versions.merge
quorum_read = versions.quorum_read
read = requests.read
write = requests.write
page = scans.page
ring_of = ring.build
replicas = ring.replicas
