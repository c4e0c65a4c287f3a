"""The log as a stream: live forwarding, latest state, and writes taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import composite_key, ring_hash
from ..operators import ring


def tail(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet log folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def forwarded(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Log rows whose key falls in a moving range, with the range; the same for streams and tables."""
    hashed = log.withColumn("hash", ring_hash(composite_key(F.col("tenant_id"), F.col("key"))))
    return ring.in_ranges(hashed, ranges)


def taken_once(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Requests (with event_time and store_key) whose key was not taken within the watermark; state is dropped behind it."""
    return requests.withWatermark("event_time", ttl).dropDuplicatesWithinWatermark(["store_key"])


def run_available(stream: DataFrame, checkpoint: str, sink) -> None:
    """Works off what is there and ends; sink(batch, id) gets each micro-batch."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Registry:
    """The running streams of a session by name; a name is used once at a time."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _find(self, name: str):
        return next((q for q in self.spark.streams.active if q.name == name), None)

    def add(self, name: str, frame: DataFrame, checkpoint: str, sink):
        if self._find(name) is not None:
            raise ValueError(f"stream {name} is running")
        return frame.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint).start()

    def get(self, name: str):
        found = self._find(name)
        if found is None:
            raise KeyError(name)
        return found

    def remove(self, name: str) -> None:
        self.get(name).stop()

    def names(self) -> list[str]:
        return sorted(q.name for q in self.spark.streams.active if q.name)
