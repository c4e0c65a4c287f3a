"""Metadata tables (tenants, nodes, pending changes, migrations) and their mutations, as tables in and tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def get(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    return table.where(F.col(key) == value)


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with the rows whose key it lacks; others are refused (see refused())."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def refused(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that insert() does not take, as their key exists."""
    return rows.join(table.select(key), key, "left_semi")


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def put(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """`table` with each key's last row by `order` in place of its own, whatever columns `rows` has of it."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("new"))
    joined = table.join(last, key, "full_outer")
    given = set(rows.columns)
    return joined.select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in given and c != key else F.col(c) for c in table.columns])


def update_factor(tenants: DataFrame, changes: DataFrame, most: int = 10) -> DataFrame:
    """Every tenant with replication_factor, version, old_factor and outcome of a change (tenant_id, rf, version) asked for.

    A change holds if its version is the next one and its factor is allowed; a change to the same factor changes nothing.
    """
    new, old = F.col("rf"), F.col("replication_factor")
    outcome = F.when(new.isNull(), "none").when(~rules.factor_valid(new, most), "invalid").when(new == old, "unchanged").when(F.col("asked") == F.col("version") + 1, "updated").otherwise("conflict")
    joined = tenants.join(changes.select("tenant_id", "rf", F.col("version").alias("asked")), "tenant_id", "left").withColumn("outcome", outcome)
    done = F.col("outcome") == "updated"
    return joined.select("tenant_id", F.when(done, new).otherwise(old).alias("replication_factor"), F.when(done, F.col("asked")).otherwise(F.col("version")).alias("version"), old.alias("old_factor"), "outcome")


def apply_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """`nodes` after changes (seq, node_id, op add | remove | state, state): each node's last change counts; a node that is not
    there is added by add only, and a state that may not follow (DOWN always may) is not taken."""
    last = changes.groupBy("node_id").agg(F.max_by(F.struct("op", F.col("state").alias("new_state")), "seq").alias("c")).select("node_id", "c.*")
    both = nodes.join(last, "node_id", "full_outer")
    there, op = F.col("state").isNotNull(), F.coalesce("op", F.lit("none"))
    state = F.when(there & (op == "state") & rules.state_allowed(F.col("state"), F.col("new_state")), F.col("new_state")).when(~there & (op == "add"), "BOOTSTRAPPING").otherwise(F.col("state"))
    return both.where((op != "remove") & (there | (op == "add"))).select("node_id", state.alias("state"), F.coalesce("virtual_nodes", F.lit(150)).alias("virtual_nodes"))


def apply_changes(pending: DataFrame, events: DataFrame) -> DataFrame:
    """`pending` after events (seq, change_id, op insert | update | delete, status, ts): an id's events count in their order, so
    its last event decides; an update of an id that was never inserted is not taken."""
    known = pending.select("change_id", F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "status", F.col("start_time").alias("ts"))
    every = known.unionByName(events.select("change_id", "seq", "op", "status", "ts"))
    folded = every.groupBy("change_id").agg(
        F.max_by("op", "seq").alias("op"), F.max_by("status", "seq").alias("status"), F.min(F.when(F.col("op") == "insert", F.col("ts"))).alias("start_time"), F.max_by("ts", "seq").alias("last_updated"))
    return folded.where((F.col("op") != "delete") & F.col("start_time").isNotNull()).drop("op")


def list_pending(changes: DataFrame, status: str | None = None) -> DataFrame:
    """Pending changes, the latest first, of one status or all."""
    found = changes if status is None else changes.where(F.col("status") == status)
    return found.orderBy(F.desc("start_time"), "change_id")


def migration_status(migrations: DataFrame, now: Column) -> DataFrame:
    """What a client sees of migrations: share done and seconds they took or have taken."""
    done = F.when(F.col("total_keys") > 0, F.col("keys_migrated") * 100.0 / F.col("total_keys")).otherwise(F.lit(0.0))
    return migrations.select("migration_id", "node_id", "status", done.alias("percentage"), (F.coalesce("completed_at", now) - F.col("started_at")).alias("took_s"))


def verdicts(pending: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Whether the data that pending changes (change_id, status, progress, completed_at, last_updated) moved may be removed."""
    normal = nodes.agg(F.count_if(F.col("state") == "NORMAL").alias("normal"))
    said = rules.cleanup_verdict(F.col("status"), F.col("progress"), F.col("completed_at"), F.col("last_updated"), F.lit(now), F.col("normal"))
    return pending.join(F.broadcast(normal)).select("change_id", said.alias("verdict"))
