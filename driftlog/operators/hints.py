"""Writes that a replica missed: kept per node, replayed when it is back, dropped when old or tried too often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def page(hints: DataFrame, node: str | None = None, tenant: str | None = None, after: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Hints by age, of a node, a tenant or from a time on where given; Spark keeps limit + offset rows a task at most."""
    for column, value in (("target_node_id", node), ("tenant_id", tenant)):
        hints = hints if value is None else hints.where(F.col(column) == value)
    hints = hints if after is None else hints.where(F.col("created_at") > after)
    return hints.orderBy("created_at", "hint_id").offset(offset).limit(limit)


def capped(hints: DataFrame, most: int) -> DataFrame:
    """The `most` latest hints of each node. Spark keeps that many of a node in each task before the shuffle."""
    order = Window.partitionBy("target_node_id").orderBy(F.desc("created_at"), F.desc("hint_id"))
    return hints.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def replay(hints: DataFrame, up: DataFrame, now: int, ttl: int = 10_800, retries: int = 10) -> DataFrame:
    """hint_id, target_node_id, outcome and replay_count after one round: expired, dropped, replayed or kept.

    A hint for a node that is not in `up` fails; it is dropped when that was its last try.
    """
    back = hints.join(up.select(F.col("node_id").alias("target_node_id"), F.lit(True).alias("is_up")), "target_node_id", "left")
    outcome = (
        F.when(rules.expired(F.col("created_at"), F.lit(now), F.lit(ttl)), "expired")
        .when(F.col("is_up"), "replayed")
        .when(F.col("replay_count") + 1 >= retries, "dropped")
        .otherwise("kept")
    )
    out = back.withColumn("outcome", outcome)
    return out.select("hint_id", "target_node_id", "outcome", (F.col("replay_count") + F.when(F.col("outcome").isin("kept", "dropped"), 1).otherwise(0)).cast("long").alias("replay_count"))


def settled(hints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """`hints` after a round: kept ones with their new count, and none of the others."""
    kept = outcomes.where(F.col("outcome") == "kept").select("hint_id", F.col("replay_count").alias("new_count"))
    return hints.join(kept, "hint_id").withColumn("replay_count", F.col("new_count")).drop("new_count")


def ttl_cache(entries: DataFrame, now: int, ttl: int, most: int) -> DataFrame:
    """The latest entry of each key that has not expired, and of these the `most` latest."""
    rest = [c for c in entries.columns if c != "key"]
    last = entries.where(~rules.expired(F.col("stored_at"), F.lit(now), F.lit(ttl))).groupBy("key").agg(F.max_by(F.struct(*rest), "stored_at").alias("e")).select("key", "e.*")
    return last.orderBy(F.desc("stored_at"), "key").limit(most)
