"""The mutation log as files: JSON lines as a store writes them, and sorted snapshots with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "SequenceNumber long, TenantID string, Key string, Value binary, VectorClock struct<Entries:array<struct<CoordinatorNodeID:string,LogicalTimestamp:long>>>, Timestamp long, OperationType string, Checksum long"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of files (a folder, a glob, or a list of either) with `valid`; files that go or cannot be read are passed by."""
    return parsed(spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(path))


def parsed(line: DataFrame) -> DataFrame:
    """Log rows of lines (value), with `valid`: the line parses and its checksum, if not 0, is that of the line with checksum 0."""
    bare = F.crc32(F.regexp_replace("value", '"Checksum":[0-9]+}$', '"Checksum":0}').cast("binary"))
    e = F.from_json("value", LINE)
    rows = line.select(e.alias("e"), bare.alias("crc"))
    clock = F.map_from_entries(F.transform(F.coalesce("e.VectorClock.Entries", F.array().cast("array<struct<CoordinatorNodeID:string,LogicalTimestamp:bigint>>")), lambda x: F.struct(x["CoordinatorNodeID"].alias("key"), x["LogicalTimestamp"].alias("value"))))
    return rows.select(F.col("e.SequenceNumber").alias("seq"), F.col("e.TenantID").alias("tenant_id"), F.col("e.Key").alias("key"), F.col("e.Value").alias("value"), clock.alias("vc"), F.col("e.Timestamp").alias("ts"), F.col("e.OperationType").alias("op"), (F.col("e.SequenceNumber").isNotNull() & ((F.col("e.Checksum") == 0) | (F.col("e.Checksum") == F.col("crc")))).alias("valid"))


def write_lines(log: DataFrame, path: str) -> None:
    """Log rows (seq, tenant_id, key, value, ts, op) as lines with checksums."""
    fields = lambda crc: F.concat(F.lit('{"SequenceNumber":'), F.col("seq").cast("string"), F.lit(',"TenantID":"'), "tenant_id", F.lit('","Key":"'), "key", F.lit('","Value":"'), F.base64(F.col("value").cast("binary")), F.lit('","VectorClock":{"Entries":null},"Timestamp":'), F.col("ts").cast("string"), F.lit(',"OperationType":"'), "op", F.lit('","Checksum":'), crc, F.lit("}"))
    log.select(fields(F.crc32(fields(F.lit("0")).cast("binary")).cast("string")).alias("value")).write.mode("append").text(path)


def write_snapshot(rows: DataFrame, path: str, files: int = 8) -> None:
    """Rows sorted by tenant and key in Parquet with Bloom filters on the key, so scans by key prune files and row groups."""
    rows.repartitionByRange(files, "tenant_id", "key").sortWithinPartitions("tenant_id", "key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File, least and greatest composite key and rows of each file of a snapshot."""
    key = F.concat("tenant_id", F.lit(":"), "key")
    return spark.read.parquet(path).select(F.input_file_name().alias("file"), key.alias("k")).groupBy("file").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count("*").alias("n"))
