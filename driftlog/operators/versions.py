"""Which version of a key counts: latest by arrival or time, clock frontier, literal fold, compaction, quorum reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks

KEY = ["tenant_id", "key"]


def latest(log: DataFrame, *order: str) -> DataFrame:
    """The last row of each key by `order` (seq if not given); partial aggregates run before the shuffle."""
    order = order or ("seq",)
    rest = [c for c in log.columns if c not in KEY]
    best = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in rest])


def live(log: DataFrame) -> DataFrame:
    return latest(log).where("not is_tombstone")


def clock_of(*coords: str):
    """A clock of count columns, without zeros."""
    every = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in coords])
    return F.map_from_entries(F.filter(every, lambda e: e["value"] > 0))


def frontier(state: DataFrame) -> DataFrame:
    """The version of each key that no other is after, by time and seq if there are several; the number of distinct maximal
    clocks, and of replicas. Rows of equal clocks count once before they meet, so a key has a row for each clock."""
    row = F.struct("ts", "seq", "node_id", "clock", "value", "is_tombstone", F.map_entries("vc").alias("entries"))
    one = state.withColumn("clock", clocks.shown(F.col("vc"))).groupBy(*KEY, "clock").agg(F.max_by(row, F.struct("ts", "seq", "node_id")).alias("v"), F.count("*").alias("n"))
    met = one.groupBy(*KEY).agg(F.collect_list("v").alias("all"), F.sum("n").alias("n_replicas"))
    clock = lambda x: F.map_from_entries(x["entries"])
    top = F.filter("all", lambda x: ~F.exists("all", lambda y: clocks.compare(clock(y), clock(x)) == "After"))
    best = met.select(*KEY, "n_replicas", top.alias("top"))
    return best.select(*KEY, F.size("top").cast("long").alias("n_maximal"), "n_replicas", F.array_max("top").dropFields("entries").alias("winner")).select(*KEY, "n_maximal", "n_replicas", "winner.*")


def fold(state: DataFrame, arrival: str) -> DataFrame:
    """The literal fold over replicas in the order of `arrival`: later clocks replace, concurrent ones flag a conflict and
    replace if newer."""
    met = state.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(arrival).alias("arrival"), "ts", "node_id", F.map_entries("vc").alias("e")))).alias("all"))
    first = F.element_at("all", 1)
    start = F.struct(first["ts"].alias("ts"), first["node_id"].alias("node_id"), first["e"].alias("e"), F.lit(False).alias("conflict"))

    def step(s, x):
        c = clocks.compare(F.map_from_entries(x["e"]), F.map_from_entries(s["e"]))
        take = (c == "After") | ((c == "Concurrent") & (x["ts"] > s["ts"]))
        pick = lambda n: F.when(take, x[n]).otherwise(s[n]).alias(n)
        return F.struct(pick("ts"), pick("node_id"), pick("e"), (s["conflict"] | (c == "Concurrent")).alias("conflict"))

    out = met.withColumn("f", F.aggregate(F.slice(F.col("all"), F.lit(2), F.size("all")), start, step))
    return out.select(*KEY, F.col("f.node_id").alias("node_id"), F.col("f.ts").alias("ts"), clocks.shown(F.map_from_entries("f.e")).alias("clock"), F.col("f.conflict").alias("has_conflict"))


def compact(levels: DataFrame, whole: bool = True) -> DataFrame:
    """One version a key; tombstones go only if all levels take part, else older versions below could come back."""
    best = latest(levels)
    return best.where("not is_tombstone") if whole else best


def merge(files: DataFrame, whole: bool = True) -> DataFrame:
    """One version a key of rows with clocks (vc): one that no other is after, and of concurrent ones the latest by ts, seq and
    the text of the clock.

    Rows of one key with equal clocks count once, the latest of them, before they meet; so a key has a row for each clock.
    """
    rest = [c for c in files.columns if c not in KEY and c not in ("ts", "seq", "vc")]
    row = F.struct("ts", "seq", F.col("shown"), F.map_entries("vc").alias("entries"), *rest)
    one = files.withColumn("shown", clocks.shown(F.col("vc"))).groupBy(*KEY, "shown").agg(F.max_by(row, F.struct("ts", "seq")).alias("v"))
    met = one.groupBy(*KEY).agg(F.collect_list("v").alias("all"))
    clock = lambda x: F.map_from_entries(x["entries"])
    top = F.filter("all", lambda x: ~F.exists("all", lambda y: clocks.compare(clock(y), clock(x)) == "After"))
    best = met.select(*KEY, F.array_max(top).alias("w"))
    out = best.select(*KEY, "w.ts", "w.seq", F.map_from_entries("w.entries").alias("vc"), *[F.col(f"w.{c}").alias(c) for c in rest])
    return out.where("not is_tombstone") if whole else out


def merged_clocks(rows: DataFrame) -> DataFrame:
    """The clock of each key that has the highest count of every coordinator; counts are merged before the shuffle."""
    each = rows.select(*KEY, F.explode("vc").alias("coord", "n")).groupBy(*KEY, "coord").agg(F.max("n").alias("n"))
    return each.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("coord", "n"))).alias("vc"))


def due(levels: DataFrame, most: int = 100) -> DataFrame:
    """The levels (level, files, bytes) that a round of compaction takes, lowest first, `most` at a time: four files in level 0, or
    more bytes than the level may have."""
    limit = F.lit(100_000.0) * F.pow(F.lit(10.0), F.greatest(F.col("level") - 2, F.lit(0)))
    return levels.where(F.when(F.col("level") == 0, F.col("files") >= 4).otherwise(F.col("bytes") > limit)).orderBy("level").limit(most)


def put_bytes(log: DataFrame) -> DataFrame:
    """Bytes that a memtable counts for all puts, overwritten ones too, and the puts."""
    size = F.octet_length("tenant_id") + 1 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 64
    return log.agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("n"))


def quorum_read(requests: DataFrame, tenants: DataFrame, state: DataFrame) -> DataFrame:
    """Of each key asked for: replicas that have it, quorum, the winner and whether versions conflict.

    `state` has one row per replica; the tenant table joins by key and is broadcast by Spark while small.
    """
    found = frontier(state.where("not is_tombstone"))
    asked = requests.select(*KEY).distinct().join(tenants.select("tenant_id", "replication_factor"), "tenant_id")
    out = asked.join(found, KEY, "left")
    n = F.least(F.coalesce("n_replicas", F.lit(0)), F.col("replication_factor").cast("long"))
    need = (F.floor(F.col("replication_factor") / 2) + 1).cast("long")
    return out.select(*KEY, "value", "clock", n.cast("long").alias("replica_count"), need.alias("required"), (n >= need).alias("quorum_met"), (F.coalesce("n_maximal", F.lit(0)) > 1).alias("has_conflict"), F.col("n_replicas").isNotNull().alias("found"))
