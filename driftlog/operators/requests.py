"""Reads and writes of requests by consistency level: replicas by the ring, answers, quorum, clocks, repeated requests, hints."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks, rules
from ..functions.scalars import composite_key, ring_hash
from . import ring, versions

KEY = ["tenant_id", "key"]


def store_key() -> "F.Column":
    return F.concat(F.lit("idempotency:"), "tenant_id", F.lit(":"), "key", F.lit(":"), "idempotency_key")


def _in_order(df: DataFrame, keys: list[str], order: list[str], schema: str, step) -> DataFrame:
    """step(state, row) -> (state, output row or None) over the rows of each key in their order, state None at its first.

    Rows of a key stream past one state, however many they are.
    """
    import pandas as pd

    columns, n = [c.split()[0] for c in schema.split(", ")], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = len(keys)

    def run(batches: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:width] != at:
                    at, state = row[:width], None
                state, given = step(state, row[width:])
                if given is not None:
                    out.append(given)
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def accepted(requests: DataFrame, ttl: int = 86_400) -> DataFrame:
    """request_id of the requests that are carried out: of one idempotency key the first, and again the first that comes more than
    `ttl` seconds after the last that was. Requests without such a key all are."""

    def step(last, row):
        ts, request_id = row
        return (ts, (request_id,)) if last is None or ts - last > ttl else (last, None)

    keyed = requests.where("idempotency_key is not null").select(*KEY, "idempotency_key", "ts", "request_id")
    return _in_order(keyed, [*KEY, "idempotency_key"], ["ts", "request_id"], "request_id long", step).union(requests.where("idempotency_key is null").select("request_id"))


def limited(requests: DataFrame, rate: float = 1.0, burst: int = 3) -> DataFrame:
    """request_id and passed: whether a token bucket of each tenant and hour lets a request through."""

    def step(state, row):
        ts, request_id = row
        left, at = state or (float(burst), ts)
        left = min(float(burst), left + (ts - at) * rate)
        passed = left >= 1.0
        return (left - passed, ts), (request_id, passed)

    asked = requests.select("tenant_id", F.floor(F.col("ts") / 3600).alias("hour"), "ts", "request_id")
    return _in_order(asked, ["tenant_id", "hour"], ["ts", "request_id"], "request_id long, passed boolean", step)


def answered(requests: DataFrame, stored: DataFrame, ttl: int = 86_400) -> DataFrame:
    """request_id and answer of the requests whose answer is stored (store_key, stored_at, answer) and not older than `ttl`."""
    asked = requests.where("idempotency_key is not null").select("request_id", "ts", store_key().alias("store_key"))
    met = asked.join(stored, "store_key").where(F.col("ts").between(F.col("stored_at"), F.col("stored_at") + ttl))
    return met.groupBy("request_id").agg(F.max_by("answer", "stored_at").alias("answer"))


def replicas(requests: DataFrame, tenants: DataFrame, ring_: DataFrame) -> DataFrame:
    """tenant_id, key, replica, rank and replication_factor of the replicas of each key asked for; tenants join by id."""
    most = tenants.agg(F.max("replication_factor")).first()[0] or 1
    keys = requests.select(*KEY).distinct().withColumn("hash", ring_hash(composite_key(F.col("tenant_id"), F.col("key"))))
    found = ring.replicas(keys, ring_, most).drop("hash")
    return found.join(tenants.select("tenant_id", "replication_factor"), "tenant_id").where(F.col("rank") <= F.col("replication_factor"))


def read(requests: DataFrame, tenants: DataFrame, ring_: DataFrame, state: DataFrame) -> DataFrame:
    """Each request with its level, what its replicas have, and a status: ok, quorum_not_met or not_found.

    A key's replicas are read once, whatever the number of requests. A replica that has a tombstone has not found the key.
    """
    held = replicas(requests, tenants, ring_).select(*KEY, F.col("replica").alias("node_id"))
    top = versions.frontier(state.where("not is_tombstone").join(held, [*KEY, "node_id"]))
    asked = requests.select("request_id", *KEY, rules.consistency(F.col("consistency")).alias("level"))
    out = asked.join(tenants.select("tenant_id", "replication_factor"), "tenant_id").join(top, KEY, "left")
    n = F.coalesce("n_replicas", F.lit(0)).cast("long")
    need = rules.required(F.col("level"), F.col("replication_factor"))
    status = F.when(n == 0, "not_found").when(n < need, "quorum_not_met").otherwise("ok")
    return out.select("request_id", *KEY, "level", need.alias("required"), n.alias("n_found"), status.alias("status"), F.when(status == "ok", F.col("value")).alias("value"), F.when(status == "ok", F.col("clock")).alias("clock"), (F.coalesce("n_maximal", F.lit(0)) > 1).alias("has_conflict"))


def existing(state: DataFrame, held: DataFrame, up: DataFrame) -> DataFrame:
    """The clock of each key on the first of its replicas that answers and has it."""
    found = state.where("not is_tombstone").join(held.select(*KEY, F.col("replica").alias("node_id"), "rank"), [*KEY, "node_id"]).join(up.select("node_id"), "node_id", "left_semi")
    return found.groupBy(*KEY).agg(F.min_by(F.map_entries("vc"), F.col("rank")).alias("entries")).select(*KEY, F.map_from_entries("entries").alias("vc"))


def fan_out(requests: DataFrame, tenants: DataFrame, ring_: DataFrame, state: DataFrame, up: DataFrame) -> DataFrame:
    """A row for each replica of each request (with coord, the coordinator): its new clock, and whether the replica took it. Those
    that did not are hints for it."""
    held = replicas(requests, tenants, ring_)
    old = existing(state, held, up)
    clock = clocks.increment(F.coalesce("vc", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), F.col("coord"))
    rows = requests.join(old, KEY, "left").withColumn("new_clock", clock).drop("vc").join(held, KEY)
    acks = up.select(F.col("node_id").alias("replica"), F.lit(True).alias("is_up"))
    return rows.join(acks, "replica", "left").withColumn("ack", F.coalesce("is_up", F.lit(False))).drop("is_up")


def write(requests: DataFrame, tenants: DataFrame, ring_: DataFrame, state: DataFrame, up: DataFrame, stored: DataFrame, ttl: int = 86_400) -> DataFrame:
    """The answer to each write: replayed (a stored answer), repeated (of another of these requests), ok or quorum_not_met, with
    level, required and given acknowledgements and the new clock.

    Requests of one batch start from the same stored state; the order of repeated ones is that of time and id.
    """
    replayed = answered(requests, stored, ttl)
    fresh = requests.join(replayed.select("request_id"), "request_id", "left_anti")
    first = fresh.join(accepted(fresh, ttl), "request_id", "left_semi")
    acks = fan_out(first, tenants, ring_, state, up).groupBy("request_id").agg(F.count_if("ack").alias("acks"), F.any_value(clocks.shown(F.col("new_clock"))).alias("clock"))
    out = requests.withColumn("level", rules.consistency(F.col("consistency"))).join(tenants.select("tenant_id", "replication_factor"), "tenant_id")
    out = out.join(replayed, "request_id", "left").join(acks, "request_id", "left")
    need = rules.required(F.col("level"), F.col("replication_factor"))
    status = F.when(F.col("answer").isNotNull(), "replayed").when(F.col("acks").isNull(), "repeated").when(F.col("acks") >= need, "ok").otherwise("quorum_not_met")
    return out.select("request_id", *KEY, "level", need.alias("required"), F.coalesce("acks", F.lit(0)).cast("long").alias("acks"), status.alias("status"), "clock", "answer")
