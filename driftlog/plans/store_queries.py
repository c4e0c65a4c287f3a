"""Queries of the store's operators: each is a call of the library over derived tables, and SQL of its own for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bloom, clocks, rules, scalars
from ..operators import hints, metadata, requests, scans, versions
from ..operators import ring as rings
from ..streaming import streams
from .catalog import _STATE, AS_OF, LATEST, _frontier, _replica_sql, _ring, _state
from .fixtures import table

BEATS_CLOCK = "b.c0 >= a.c0 and b.c1 >= a.c1 and b.c2 >= a.c2 and (b.c0 > a.c0 or b.c1 > a.c1 or b.c2 > a.c2)"
IN_RANGE = "(r.lo < r.hi and x.hash >= r.lo and x.hash < r.hi) or (r.lo > r.hi and (x.hash >= r.lo or x.hash < r.hi))"
LEVEL = "case when r.consistency in ('one', 'quorum', 'all') then r.consistency else 'quorum' end"
NEED = f"case {LEVEL} when 'one' then 1 when 'all' then t.replication_factor else t.replication_factor div 2 + 1 end"
HELD = f"select h.tenant_id, h.key, h.replica, h.rank from ({_replica_sql(3)}) h join tenants t on h.tenant_id = t.tenant_id where h.rank <= t.replication_factor"
#: requests that are carried out, in DuckDB's words: chains of first requests by key, each after the last one's time to live
CHAIN = """o as (select *, ts * 10000000 + request_id ord from fresh where idempotency_key is not null),
  chain as (select tenant_id, key, idempotency_key, min(ord) ord from o group by tenant_id, key, idempotency_key
    union all select c.tenant_id, c.key, c.idempotency_key, min(o.ord) from chain c join o on o.tenant_id = c.tenant_id and o.key = c.key and o.idempotency_key = c.idempotency_key and o.ts > c.ord div 10000000 + 86400 group by c.tenant_id, c.key, c.idempotency_key, c.ord),
  carried as (select ord % 10000000 request_id from chain union all select request_id from fresh where idempotency_key is null)"""


def _log_bytes(spark, d, more: int):
    return table(spark, d, "kv_log").withColumn("size", F.octet_length("value") + more)


def _segments(spark, d):
    rows = scans.running(_log_bytes(spark, d, 100).select("seq", "size"), "seq", weight=F.col("size"))
    return rows.select("seq", F.floor((F.col("before") + F.col("size") - 1) / 65536).cast("long").alias("segment"))


def _epochs(spark, d):
    log = table(spark, d, "kv_log").select("seq", "key", (F.octet_length("value") + F.octet_length("key") + 64).alias("size"))
    rows = scans.running(log, "seq", weight=F.col("size")).withColumn("epoch", F.floor((F.col("before") + F.col("size") - 1) / 131072).cast("long"))
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def _evicted(spark, d):
    """The least used entries, beyond 8192 bytes for the most used."""
    entries = table(spark, d, "kv_log").groupBy("tenant_id", "key").agg(F.count("*").alias("n"), (F.max(F.octet_length("value")) + 64).alias("size"))
    place = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), "tenant_id", F.lit("\x01"), "key")
    rows = scans.running(entries.withColumn("place", place), "place", weight=F.col("size"))
    return rows.where(F.col("before") + F.col("size") > 8192).select("tenant_id", "key", "n")


def _gauges(of):
    return lambda s, d: of(table(s, d, "gauges"))


def _codes(of):
    return lambda s, d: of(table(s, d, "codes"))


def _pending(spark, d):
    one = F.create_map(F.lit("n1"), F.lit("completed"), F.lit("n2"), F.col("stream_state"))
    return table(spark, d, "pending").withColumn("progress", one)


def _factor_changes(spark, d):
    """A change asked for each tenant, one of a factor that is not allowed and one of an old version among them."""
    return spark.sql("select * from values ('t0', 3, 2), ('t1', 3, 5), ('t2', 11, 2), ('t3', 3, 3) as v(tenant_id, rf, version)")


def _up(spark, d):
    return table(spark, d, "nodes").where("state = 'NORMAL'").select("node_id")


def _write(spark, d):
    asked = table(spark, d, "requests").withColumn("coord", F.concat(F.lit("c"), (F.col("request_id") % 3).cast("string")))
    return requests.write(asked, table(spark, d, "tenants"), _ring(spark, d), _state(spark, d), _up(spark, d), table(spark, d, "stored"))


def _fan_out(spark, d):
    """Writes that a replica did not take: a hint for each."""
    asked = table(spark, d, "requests").withColumn("coord", F.lit("c0"))
    rows = requests.fan_out(asked, table(spark, d, "tenants"), _ring(spark, d), _state(spark, d), _up(spark, d))
    return rows.where("not ack").groupBy("replica").agg(F.count("*").alias("n_hints"))


def _hint_round(spark, d):
    return hints.replay(table(spark, d, "hints"), _up(spark, d), AS_OF, ttl=1_000_000)


def _blooms(spark, d):
    """How many keys of the log and of others a filter of the log's keys may have: all, and the false positives."""
    log = table(spark, d, "keys").select(F.concat("tenant_id", F.lit(":"), "key").alias("k"))
    made = bloom.build(log, "k", 100_000, 0.001)
    kept = bloom.might_contain(log.union(log.select(F.concat(F.lit("other "), "k"))), "k", made, 100_000, 0.001)
    return kept.agg(F.count_if(~F.col("k").startswith("other ")).alias("n_held"), (F.count_if(F.col("k").startswith("other ")) <= 5).alias("few_others"))


def _ring_changes(spark, d):
    """Virtual nodes by node after one joins and one leaves."""
    now = rings.remove(rings.add(_ring(spark, d), spark.sql("select 'n7' node_id, 40 virtual_nodes")), spark.sql("select 'n1' node_id"))
    return now.groupBy("node_id").agg(F.count("*").alias("n"), F.min("hash").alias("first_hash"))


def _replay(spark, d):
    """Valid lines of the log, replayed; damaged ones are told by their checksum."""
    from ..sources.log import parsed
    from .catalog import _log_lines

    rows = parsed(_log_lines(spark, d).withColumnRenamed("line", "value")).where("valid").withColumn("value", F.col("value").cast("string"))
    return versions.latest(rows.select("tenant_id", "key", "value", "seq"))


def _framed(spark, d):
    """Frames of which every fifth is damaged: whether their checksums hold."""
    frame = scalars.crc_frame(F.col("value").cast("binary"))
    damaged = F.when(F.col("seq") % 5 == 0, F.concat(frame, F.lit(bytearray(b"x")))).otherwise(frame)
    return table(spark, d, "kv_log").select("seq", scalars.crc_valid(damaged).alias("valid"))


def _keys_checked(spark, d):
    key, turn = F.col("key"), F.col("request_id") % 4
    odd = F.when(turn == 0, key).when(turn == 1, F.concat(key, F.lit("\x07"))).when(turn == 2, F.repeat(key, 600)).otherwise("")
    return table(spark, d, "requests").select("request_id", F.coalesce(scalars.key_error(odd), F.lit("")).alias("error"))


def _sanitized(spark, d):
    dirty = F.concat(F.lit(" \x01"), "tenant_id", F.lit(":"), F.lit("ééé€"), "key", F.lit(" \t"))
    return table(spark, d, "keys").select("tenant_id", "key", *[rules.sanitize_tenant(dirty, n).alias(f"cut_{n}") for n in (3, 5, 9, 256)], rules.sanitize_key(dirty, 1024).alias("whole"))


def _moving(spark, d, node: str, joins: bool):
    """Keys copied when a node joins the ring, or leaves it."""
    whole = _ring(spark, d)
    less = whole.where(F.col("node_id") != node)
    found = rings.moves(table(spark, d, "keys"), *((whole, less) if joins else (less, whole)))
    return found.groupBy("from_node", "to_node").agg(F.count("*").alias("n_keys"))


def _moving_sql(node: str, joins: bool) -> str:
    rest = f"(select * from ring where node_id != '{node}')"
    owner = lambda ring: f"(select k.tenant_id, k.key, r.node_id from keys k join {ring} r on r.hash = coalesce((select min(q.hash) from {ring} q where q.hash >= k.hash), (select min(q.hash) from {ring} q)))"
    new, old = (owner("ring"), owner(rest)) if joins else (owner(rest), owner("ring"))
    return f"select o.node_id from_node, n.node_id to_node, count(*) n_keys from {new} n join {old} o on n.tenant_id = o.tenant_id and n.key = o.key where n.node_id <> o.node_id group by o.node_id, n.node_id"


def _point_gets(spark, d):
    """One row of each metadata table, as text."""
    gets = [("tenants", "tenant_id", "t2", "replication_factor"), ("nodes", "node_id", "n3", "state"), ("pending", "change_id", "p3", "status"), ("migrations", "migration_id", "m4", "status")]
    out = None
    for name, key, value, column in gets:
        row = metadata.get(table(spark, d, name), key, value).select(F.lit(name).alias("kind"), F.col(key).alias("id"), F.col(column).cast("string").alias("value"))
        out = row if out is None else out.union(row)
    return out


def _appended(spark, d):
    new = table(spark, d, "requests").select("tenant_id", "key", "value", "ts", "request_id")
    return scans.append(table(spark, d, "kv_log"), new, "ts", ("request_id",)).select("request_id", "seq")


def _authoritative(spark, d):
    """Of each key asked for: replicas, those that count, and what a quorum needs of them."""
    held = rings.authoritative(requests.replicas(table(spark, d, "requests"), table(spark, d, "tenants"), _ring(spark, d)), table(spark, d, "nodes"))
    return held.groupBy("tenant_id", "key").agg(F.count("*").alias("n_replicas"), F.count_if("counts").alias("n_counting")).withColumn("required", rules.required(F.lit("quorum"), F.col("n_counting")))


MD5_PART = " + ".join(f"cast((instr('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (8 - i)} as bigint)" for i in range(1, 9))

#: name -> (Spark, SQL for DuckDB in Spark's words).
OPERATORS = {
    # scans and sinks
    "segment_assign": (_segments, "select seq, cast(floor((sum(octet_length(value) + 100) over (order by seq) - 1) / 65536.0) as bigint) segment from kv_log"),
    "flush_epochs": (_epochs, "select epoch, count(*) n, min(key) min_key, max(key) max_key from (select key, cast(floor((sum(octet_length(value) + octet_length(key) + 64) over (order by seq) - 1) / 131072.0) as bigint) epoch from kv_log) x group by epoch"),
    "ordered_scan": (lambda s, d: scans.running(table(s, d, "keys").select(F.concat("tenant_id", F.lit(":"), "key").alias("composite_key")), "composite_key").select("composite_key", (F.col("before") + 1).alias("rank")), "select concat(tenant_id, ':', key) composite_key, cast(row_number() over (order by concat(tenant_id, ':', key)) as bigint) rank from keys"),
    "key_listing": (lambda s, d: scans.key_listing(table(s, d, "kv_log")), "select distinct concat(tenant_id, ':', key) composite_key from kv_log"),
    "key_range_page": (lambda s, d: scans.page(table(s, d, "keys"), "t1", "k1", "k3", 10), "select key, n > 10 has_more, next_key from (select *, max(case when rn = 11 then key end) over () next_key from (select key, row_number() over (order by key) rn, count(*) over () n from keys where tenant_id = 't1' and key between 'k1' and 'k3') x) y where rn <= 10"),
    "memtable_bytes": (lambda s, d: versions.put_bytes(table(s, d, "kv_log")), "select cast(sum(octet_length(tenant_id) + 1 + octet_length(key) + octet_length(value) + 64) as bigint) bytes, count(*) n from kv_log"),
    "replicate_keys": (lambda s, d: table(s, d, "requests").select("tenant_id", "key").distinct().join(versions.latest(table(s, d, "kv_log").select("tenant_id", "key", "value", "seq")), ["tenant_id", "key"]).select("tenant_id", "key", "value"), f"select l.tenant_id, l.key, x.value from (select distinct tenant_id, key from requests) l join ({LATEST}) x on l.tenant_id = x.tenant_id and l.key = x.key"),
    "log_replay": (_replay, "select tenant_id, key, max_by(value, seq) value, max(seq) seq from kv_log where seq % 97 != 0 group by tenant_id, key"),
    "compaction_clocks": (lambda s, d: versions.merge(_state(s, d)).select("tenant_id", "key", "value", "seq", clocks.shown(F.col("vc")).alias("clock")),
        f"with s as ({_STATE}), f as (select a.* from s a where not exists (select 1 from s b where a.tenant_id = b.tenant_id and a.key = b.key and {BEATS_CLOCK})) select tenant_id, key, value, seq, clock from (select *, row_number() over (partition by tenant_id, key order by ts desc, seq desc, clock desc) rn from f) x where rn = 1 and not is_tombstone"),
    "compaction_due": (lambda s, d: versions.due(table(s, d, "kv_log").groupBy((F.col("seq") % 5).alias("level")).agg(F.count_distinct(F.expr("seq div 1000")).alias("files"), F.sum(F.octet_length("value")).alias("bytes"))).select("level"),
        "select level from (select seq % 5 level, count(distinct seq div 1000) files, sum(octet_length(value)) bytes from kv_log group by seq % 5) x where case when level = 0 then files >= 4 when level < 3 then bytes > 100000 else bytes > 100000 * power(10, level - 2) end"),
    # ranges and ring
    "hash_in_ranges": (lambda s, d: rings.in_ranges(table(s, d, "keys"), table(s, d, "ranges")).select("tenant_id", "key", "range_id"), f"select x.tenant_id, x.key, r.range_id from keys x join ranges r on {IN_RANGE}"),
    "live_forward": (lambda s, d: streams.forwarded(table(s, d, "kv_log"), table(s, d, "ranges")).select("seq", "range_id"), f"select k.seq, r.range_id from kv_log k join keys x on k.tenant_id = x.tenant_id and k.key = x.key join ranges r on {IN_RANGE}"),
    "range_estimate": (lambda s, d: scans.range_estimates(table(s, d, "ranges"), table(s, d, "keys")),
        "with w as (select range_id, sum((instr('0123456789abcdef', substr(hi, i, 1)) - instr('0123456789abcdef', substr(lo, i, 1))) * power(16.0, -i)) width from ranges cross join (select unnest(range(1, 17)) i) p group by range_id) select range_id, cast(floor(n * case when width < 0 then width + 1 else width end) as bigint) keys from w cross join (select count(*) n from keys) c"),
    "ring_changes": (_ring_changes, "select node_id, count(*) n, min(hash) first_hash from (select node_id, hash from ring where node_id != 'n1' union all select 'n7', substr(sha2(concat('n7-vnode-', cast(i as string)), 256), 1, 16) from (select unnest(range(0, 40)) i) x) y group by node_id"),
    # rules
    "required_replicas": (_gauges(lambda t: t.where("rf > 0").select("id", *[rules.required(F.lit(x), F.col("rf")).alias(x) for x in rules.LEVELS])), "select id, cast(1 as bigint) one, cast(rf div 2 + 1 as bigint) quorum, cast(rf as bigint) \"all\" from gauges where rf > 0"),
    "consistency_normalize": (lambda s, d: table(s, d, "requests").select("request_id", rules.consistency(F.col("consistency")).alias("level")), "select request_id, case consistency when '' then 'quorum' else consistency end level from requests"),
    "validate_rf": (_gauges(lambda t: t.select("id", rules.factor_valid(F.col("rf")).alias("valid"))), "select id, rf >= 1 and rf <= 10 valid from gauges"),
    "request_defaults": (_gauges(lambda t: t.select("id", rules.port_valid(F.col("port")).alias("port_valid"), F.coalesce("asked_rf", F.lit(3)).alias("rf"), F.coalesce("asked_vnodes", F.lit(150)).alias("vnodes"))), "select id, port > 0 and port < 65536 port_valid, case when asked_rf is null then 3 else asked_rf end rf, case when asked_vnodes is null then 150 else asked_vnodes end vnodes from gauges"),
    "cleanup_safe": (lambda s, d: metadata.verdicts(_pending(s, d), table(s, d, "nodes"), AS_OF), f"select change_id, case when status <> 'completed' then 'not completed' when stream_state <> 'completed' then 'streaming still active' when {AS_OF} - case when completed_at is null then last_updated else completed_at end < 86400 then 'grace period not elapsed' when (select count(*) from nodes where state = 'NORMAL') < 3 then 'quorum not met' else 'safe' end verdict from pending"),
    "disk_gate": (_gauges(lambda t: t.select("id", rules.disk_gate(F.col("used"), F.col("est"), F.col("avail")).alias("gate"))), "select id, case when used >= 95 then 'reject' when used >= 90 and est > avail / 10.0 then 'reject' when est > avail then 'reject' else 'accept' end gate from gauges"),
    "health_status": (_gauges(lambda t: t.select("id", rules.health(F.col("cpu"), F.col("mem"), F.col("disk"), F.col("err")).alias("status"))), "select id, case when cpu > 90 or mem > 90 or disk > 90 then 'degraded' when err > 0.1 then 'unhealthy' else 'healthy' end status from gauges"),
    "pool_rates": (_gauges(lambda t: t.select("id", rules.pool_rates(*[F.col(c) for c in ("queued", "capacity", "active", "workers", "done", "failed")]).alias("r")).select("id", "r.*")), "select id, case when capacity = 0 then 0.0 else cast(queued as double) * 100 / capacity end queue_pct, case when workers = 0 then 0.0 else cast(active as double) * 100 / workers end worker_pct, case when done + failed = 0 then 100.0 else cast(done as double) * 100 / (done + failed) end success_pct from gauges"),
    "retry_schedule": (_codes(lambda t: t.select("id", rules.retryable(F.col("call_code")).alias("retry"), rules.backoff_ms(F.col("attempt")).alias("wait_ms"))), "select id, call_code in ('Unavailable', 'DeadlineExceeded', 'Aborted', 'ResourceExhausted') retry, cast(case attempt when 1 then 100 when 2 then 200 when 3 then 400 else 800 end as bigint) wait_ms from codes"),
    "error_map": (_codes(lambda t: t.select("id", rules.http_status(F.col("call_code")).alias("http"))), "select id, case when call_code = 'OK' then 200 when call_code in ('InvalidArgument', 'OutOfRange') then 400 when call_code = 'Unauthenticated' then 401 when call_code = 'PermissionDenied' then 403 when call_code = 'NotFound' then 404 when call_code in ('AlreadyExists', 'Aborted') then 409 when call_code = 'FailedPrecondition' then 412 when call_code = 'ResourceExhausted' then 429 when call_code = 'Unimplemented' then 501 when call_code = 'Unavailable' then 503 when call_code = 'DeadlineExceeded' then 504 else 500 end http from codes"),
    "store_errors": (_codes(lambda t: t.select("id", rules.call_code(F.col("store_code")).alias("call"))), "select id, case when store_code = 'OK' then 'OK' when store_code in ('INVALID_ARGUMENT', 'KEY_TOO_LARGE', 'VALUE_TOO_LARGE', 'INVALID_KEY') then 'InvalidArgument' when store_code = 'KEY_NOT_FOUND' then 'NotFound' when store_code in ('DISK_FULL', 'RESOURCE_EXHAUSTED') then 'ResourceExhausted' when store_code in ('DISK_THROTTLED', 'UNAVAILABLE') then 'Unavailable' when store_code in ('CHECKSUM_FAILED', 'CORRUPTED_DATA') then 'DataLoss' else 'Internal' end \"call\" from codes"),
    "api_errors": (_codes(lambda t: t.select("id", rules.api_code(F.col("call_code"), F.col("message")).alias("code"))), """select id, case when call_code = 'InvalidArgument' then 'INVALID_REQUEST' when call_code = 'NotFound' and message like '%Tenant%' then 'TENANT_NOT_FOUND' when call_code = 'NotFound' and message like '%key%' then 'KEY_NOT_FOUND' when call_code = 'NotFound' and message like 'migration%' then 'MIGRATION_NOT_FOUND'
      when call_code = 'AlreadyExists' and message like '%Tenant%' then 'TENANT_EXISTS' when call_code = 'AlreadyExists' and message like 'idempotency%' then 'IDEMPOTENCY_CONFLICT' when call_code in ('NotFound', 'AlreadyExists') then 'INVALID_REQUEST' when call_code = 'PermissionDenied' then 'FORBIDDEN' when call_code = 'Unauthenticated' then 'UNAUTHORIZED'
      when call_code = 'ResourceExhausted' then 'RATE_LIMITED' when call_code = 'Unavailable' then 'SERVICE_UNAVAILABLE' when call_code = 'DeadlineExceeded' then 'TIMEOUT' else 'INTERNAL_ERROR' end code from codes"""),
    "stream_lifecycle": (_gauges(lambda t: t.select("id", F.element_at(F.array(*map(F.lit, ["copying", "streaming", "syncing", "completed", "failed"])), (F.col("id") % 5 + 1).cast("int")).alias("state"), F.element_at(F.array(*map(F.lit, ["copied", "drained", "verified", "error"])), (F.col("queued") % 4 + 1).cast("int")).alias("step")).withColumn("next_state", rules.stream_state(F.col("state"), F.col("step")))),
        "select id, state, step, case when step = 'error' then case when state = 'completed' then state else 'failed' end when state = 'copying' and step = 'copied' then 'streaming' when state = 'streaming' and step = 'drained' then 'syncing' when state = 'syncing' and step = 'verified' then 'completed' else state end next_state from (select id, case id % 5 when 0 then 'copying' when 1 then 'streaming' when 2 then 'syncing' when 3 then 'completed' else 'failed' end state, case queued % 4 when 0 then 'copied' when 1 then 'drained' when 2 then 'verified' else 'error' end step from gauges) x"),
    "clock_faults": (lambda s, d: _state(s, d).select("node_id", "tenant_id", "key", F.coalesce(rules.clock_error(F.map_concat(F.create_map(F.lit("x"), (F.col("seq") % 5 - 1).cast("long"), F.repeat(F.lit("y"), (F.col("seq") % 140).cast("int")), F.lit(1).cast("long")), "vc")), F.lit("")).alias("fault")), "select node_id, tenant_id, key, case when seq % 140 = 0 or seq % 140 > 128 then 'clock_id_length' when seq % 5 = 0 then 'clock_negative' else '' end fault from replica_state"),
    "sanitize": (_sanitized, "select tenant_id, key, tenant_id cut_3, concat(tenant_id, 'é') cut_5, concat(tenant_id, 'ééé') cut_9, concat(tenant_id, 'ééé€', key) cut_256, concat(tenant_id, ':', 'ééé€', key) whole from keys"),
    "cache_score": (lambda s, d: table(s, d, "kv_log").groupBy("tenant_id", "key").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("tenant_id", "key", rules.cache_score(F.col("n"), F.lit(AS_OF) - F.col("last")).alias("score")), f"select tenant_id, key, cast(count(*) as double) / 2 - cast({AS_OF} - max(ts) as double) / 2 score from kv_log group by tenant_id, key"),
    "cache_evict": (_evicted, "select tenant_id, key, n from (select *, sum(bytes) over (order by n desc, tenant_id, key rows between unbounded preceding and current row) used from (select tenant_id, key, count(*) n, max(octet_length(value)) + 64 bytes from kv_log group by tenant_id, key) y) x where used > 8192"),
    "ttl_cache": (lambda s, d: hints.ttl_cache(table(s, d, "kv_log").select(F.concat("tenant_id", F.lit(":"), "key").alias("key"), F.col("ts").alias("stored_at")), AS_OF, 400_000, 50).select("key", "stored_at"), f"select key, stored_at from (select concat(tenant_id, ':', key) key, max(ts) stored_at from kv_log where {AS_OF} - ts <= 400000 group by concat(tenant_id, ':', key)) x order by stored_at desc, key limit 50"),
    "bloom_filter": (_blooms, "select count(*) n_held, true few_others from keys"),
    "crc_frame": (_framed, "select seq, seq % 5 <> 0 valid from kv_log"),
    "validate_key": (_keys_checked, "select request_id, case request_id % 4 when 0 then '' when 1 then 'key_control' when 2 then 'key_too_long' else 'key_empty' end error from requests"),
    # metadata
    "tenant_occ_update": (lambda s, d: metadata.update_factor(table(s, d, "tenants"), _factor_changes(s, d)), "select t.tenant_id, case when outcome = 'updated' then rf else replication_factor end replication_factor, case when outcome = 'updated' then asked else version end version, replication_factor old_factor, outcome from (select t.*, u.rf, u.asked, case when u.rf > 10 then 'invalid' when u.rf = t.replication_factor then 'unchanged' when u.asked = t.version + 1 then 'updated' else 'conflict' end outcome from tenants t join (values ('t0', 3, 2), ('t1', 3, 5), ('t2', 11, 2), ('t3', 3, 3)) u(tenant_id, rf, asked) on t.tenant_id = u.tenant_id) t"),
    "tenant_insert": (lambda s, d: metadata.remove(metadata.insert(table(s, d, "tenants"), s.sql("select * from values ('t3', 9, 1), ('t9', 2, 1) as v(tenant_id, replication_factor, version)"), "tenant_id"), s.sql("select 't0' tenant_id"), "tenant_id").select("tenant_id", "replication_factor", "version"), "select tenant_id, replication_factor, version from tenants where tenant_id <> 't0' union all select 't9', 2, 1"),
    "node_changes": (lambda s, d: metadata.apply_nodes(table(s, d, "nodes"), table(s, d, "node_events")),
        """select coalesce(n.node_id, c.node_id) node_id, case when n.node_id is null then 'BOOTSTRAPPING' when c.op = 'state' and concat(n.state, '>', c.state) in ('BOOTSTRAPPING>NORMAL', 'BOOTSTRAPPING>DOWN', 'NORMAL>LEAVING', 'NORMAL>DOWN', 'LEAVING>DOWN', 'DOWN>BOOTSTRAPPING') then c.state else n.state end state, coalesce(n.virtual_nodes, 150) virtual_nodes
      from nodes n full outer join (select * from (select *, row_number() over (partition by node_id order by seq desc) rn from node_events) x where rn = 1) c on n.node_id = c.node_id where (c.op is null or c.op <> 'remove') and (n.node_id is not null or c.op = 'add')"""),
    "pending_fold": (lambda s, d: metadata.apply_changes(table(s, d, "pending"), table(s, d, "pending_events")),
        """with e as (select change_id, cast(-1 as bigint) seq, 'insert' op, status, start_time ts from pending union all select change_id, seq, op, status, ts from pending_events)
      select change_id, status, start_time, ts last_updated from (select *, row_number() over (partition by change_id order by seq desc) rn, min(case when op = 'insert' then ts end) over (partition by change_id) start_time from e) x where rn = 1 and op <> 'delete' and start_time is not null"""),
    "list_pending_changes": (lambda s, d: metadata.list_pending(table(s, d, "pending"), "in_progress").select("change_id", "status", "start_time"), "select change_id, status, start_time from pending where status = 'in_progress'"),
    "migration_view": (lambda s, d: metadata.migration_status(table(s, d, "migrations"), F.lit(AS_OF)), f"select migration_id, node_id, status, case when total_keys = 0 then 0.0 else cast(keys_migrated as double) * 100 / total_keys end percentage, case when completed_at is null then {AS_OF} else completed_at end - started_at took_s from migrations"),
    # hints
    "hints_for_node": (lambda s, d: hints.page(table(s, d, "hints"), node="n2").select("hint_id", "created_at"), "select hint_id, created_at from (select hint_id, created_at, row_number() over (order by created_at, hint_id) rn from hints where target_node_id = 'n2') x where rn <= 100"),
    "list_hints": (lambda s, d: hints.page(table(s, d, "hints"), tenant="t3", after=1705000000, limit=50, offset=20).select("hint_id", "target_node_id"), "select hint_id, target_node_id from (select *, row_number() over (order by created_at, hint_id) rn from hints where tenant_id = 't3' and created_at > 1705000000) x where rn > 20 and rn <= 70"),
    "hint_cap": (lambda s, d: hints.capped(table(s, d, "hints"), 100).select("hint_id", "target_node_id"), "select hint_id, target_node_id from (select *, row_number() over (partition by target_node_id order by created_at desc, hint_id desc) rn from hints) x where rn <= 100"),
    "hint_replay_outcome": (_hint_round, f"select h.hint_id, h.target_node_id, case when {AS_OF} - created_at > 1000000 then 'expired' when target_node_id in ('n0', 'n1', 'n2') then 'replayed' when replay_count >= 9 then 'dropped' else 'kept' end outcome, case when {AS_OF} - created_at <= 1000000 and target_node_id not in ('n0', 'n1', 'n2') then replay_count + 1 else replay_count end replay_count from hints h"),
    "hints_left": (lambda s, d: hints.settled(table(s, d, "hints"), _hint_round(s, d)).select("hint_id", "replay_count"), f"select hint_id, replay_count + 1 replay_count from hints where {AS_OF} - created_at <= 1000000 and target_node_id not in ('n0', 'n1', 'n2') and replay_count < 9"),
    # requests
    "idempotent_writes": (lambda s, d: requests.accepted(table(s, d, "requests")), f"with fresh as (select * from requests), {CHAIN} select request_id from carried"),
    "idempotency_lookup": (lambda s, d: requests.answered(table(s, d, "requests"), table(s, d, "stored")), "select r.request_id, s.answer from requests r join stored s on s.store_key = concat('idempotency:', r.tenant_id, ':', r.key, ':', r.idempotency_key) where r.ts >= s.stored_at and r.ts - s.stored_at <= 86400"),
    "rate_limit": (lambda s, d: requests.limited(table(s, d, "requests")),
        """with n as (select request_id, tenant_id, ts, ts div 3600 hr, row_number() over (partition by tenant_id, ts div 3600 order by ts, request_id) rn from requests),
      bucket as (select request_id, tenant_id, hr, rn, ts, true passed, cast(2 as double) rest from n where rn = 1
        union all select n.request_id, n.tenant_id, n.hr, n.rn, n.ts, least(3, b.rest + n.ts - b.ts) >= 1, least(3, b.rest + n.ts - b.ts) - case when least(3, b.rest + n.ts - b.ts) >= 1 then 1 else 0 end from bucket b join n on n.tenant_id = b.tenant_id and n.hr = b.hr and n.rn = b.rn + 1) select request_id, passed from bucket"""),
    "existing_clock": (lambda s, d: requests.existing(_state(s, d), requests.replicas(table(s, d, "requests"), table(s, d, "tenants"), _ring(s, d)), _up(s, d)).select("tenant_id", "key", clocks.shown(F.col("vc")).alias("clock")),
        f"with held as ({HELD}), s as ({_STATE} where not is_tombstone and node_id in ('n0', 'n1', 'n2')) select tenant_id, key, clock from (select s.*, row_number() over (partition by s.tenant_id, s.key order by h.rank) rn from s join held h on h.tenant_id = s.tenant_id and h.key = s.key and h.replica = s.node_id) x where rn = 1"),
    "fan_out_hints": (_fan_out, f"with held as ({HELD}) select h.replica, count(*) n_hints from requests r join held h on r.tenant_id = h.tenant_id and r.key = h.key where h.replica not in ('n0', 'n1', 'n2') group by h.replica"),
    "read_requests": (lambda s, d: requests.read(table(s, d, "requests"), table(s, d, "tenants"), _ring(s, d), _state(s, d)),
        _frontier("where not is_tombstone and exists (select 1 from held h where h.tenant_id = replica_state.tenant_id and h.key = replica_state.key and h.replica = replica_state.node_id)").replace("with ", f"with held as ({HELD}), ", 1)
        + f"""select request_id, tenant_id, key, level, required, n_found, case when n_found = 0 then 'not_found' when n_found < required then 'quorum_not_met' else 'ok' end status, case when n_found >= required then value end value, case when n_found >= required then clock end clock, has_conflict
      from (select r.request_id, r.tenant_id, r.key, {LEVEL} level, cast({NEED} as bigint) required, coalesce(n.n_replicas, 0) n_found, w.value, w.clock, coalesce(m.n_maximal, 0) > 1 has_conflict from requests r join tenants t on r.tenant_id = t.tenant_id
        left join w on w.tenant_id = r.tenant_id and w.key = r.key and w.rn = 1 left join n on n.tenant_id = r.tenant_id and n.key = r.key left join m on m.tenant_id = r.tenant_id and m.key = r.key) x"""),
    "write_requests": (_write,
        f"""with held as ({HELD}), answers as (select r.request_id, s.answer from requests r join stored s on s.store_key = concat('idempotency:', r.tenant_id, ':', r.key, ':', r.idempotency_key) where r.ts >= s.stored_at and r.ts <= s.stored_at + 86400),
      fresh as (select * from requests where request_id not in (select request_id from answers)), {CHAIN},
      old as (select tenant_id, key, c0, c1, c2 from (select s.*, row_number() over (partition by s.tenant_id, s.key order by h.rank) rn from replica_state s join held h on h.tenant_id = s.tenant_id and h.key = s.key and h.replica = s.node_id where not s.is_tombstone and s.node_id in ('n0', 'n1', 'n2')) x where rn = 1),
      took as (select tenant_id, key, count(*) n from held where replica in ('n0', 'n1', 'n2') group by tenant_id, key),
      q as (select r.request_id, r.tenant_id, r.key, {LEVEL} level, cast({NEED} as bigint) required, case when c.request_id is null then 0 else coalesce(k.n, 0) end acks, c.request_id is not null is_carried, a.answer,
        coalesce(o.c0, 0) + case when r.request_id % 3 = 0 then 1 else 0 end x0, coalesce(o.c1, 0) + case when r.request_id % 3 = 1 then 1 else 0 end x1, coalesce(o.c2, 0) + case when r.request_id % 3 = 2 then 1 else 0 end x2
        from requests r join tenants t on r.tenant_id = t.tenant_id left join answers a on a.request_id = r.request_id left join carried c on c.request_id = r.request_id left join old o on o.tenant_id = r.tenant_id and o.key = r.key left join took k on k.tenant_id = r.tenant_id and k.key = r.key)
      select request_id, tenant_id, key, level, required, acks, case when answer is not null then 'replayed' when not is_carried then 'repeated' when acks >= required then 'ok' else 'quorum_not_met' end status,
        case when is_carried then concat_ws(',', case when x0 > 0 then concat('c0=', cast(x0 as string)) end, case when x1 > 0 then concat('c1=', cast(x1 as string)) end, case when x2 > 0 then concat('c2=', cast(x2 as string)) end) end clock, answer from q"""),
    # topology, metadata and numbers
    "bootstrap_copy": (lambda s, d: _moving(s, d, "n2", True), _moving_sql("n2", True)),
    "decommission_copy": (lambda s, d: _moving(s, d, "n1", False), _moving_sql("n1", False)),
    "authoritative_quorum": (_authoritative, f"with held as ({HELD}) select tenant_id, key, count(*) n_replicas, count(case when replica in ('n0', 'n1', 'n2') then 1 end) n_counting, count(case when replica in ('n0', 'n1', 'n2') then 1 end) div 2 + 1 required from held group by tenant_id, key"),
    "meta_point_gets": (_point_gets, "select 'tenants' kind, tenant_id id, cast(replication_factor as string) value from tenants where tenant_id = 't2' union all select 'nodes', node_id, state from nodes where node_id = 'n3' union all select 'pending', change_id, status from pending where change_id = 'p3' union all select 'migrations', migration_id, status from migrations where migration_id = 'm4'"),
    "log_append": (_appended, "select request_id, cast(row_number() over (order by ts, request_id) + (select max(seq) from kv_log) as bigint) seq from requests"),
    "range_digest": (lambda s, d: scans.digests(table(s, d, "replica_state"), ["node_id", "tenant_id"], F.concat("key", F.lit("="), F.col("seq").cast("string"))), f"select node_id, tenant_id, count(*) n, cast(sum({MD5_PART}) as bigint) digest from (select node_id, tenant_id, md5(concat(key, '=', cast(seq as string))) h from replica_state) x group by node_id, tenant_id"),
    "clock_merge": (lambda s, d: versions.merged_clocks(_state(s, d)).select("tenant_id", "key", clocks.shown(F.col("vc")).alias("clock")), "select tenant_id, key, concat_ws(',', case when max(c0) > 0 then concat('c0=', cast(max(c0) as string)) end, case when max(c1) > 0 then concat('c1=', cast(max(c1) as string)) end, case when max(c2) > 0 then concat('c2=', cast(max(c2) as string)) end) clock from replica_state group by tenant_id, key"),
    "generated_keys": (lambda s, d: table(s, d, "requests").where("idempotency_key is null").select("request_id", scalars.generated_key(F.col("tenant_id"), F.col("key"), F.col("ts") * 1_000_000_000, F.lit("salt")).alias("made")), "select request_id, sha2(concat(tenant_id, ':', key, ':', cast(ts * 1000000000 as string), ':salt'), 256) made from requests where idempotency_key is null"),
    "log_days": (lambda s, d: table(s, d, "kv_log").groupBy(scalars.day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.max(F.lit(AS_OF) - F.col("ts")).alias("age_s")), f"select strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as \"day\", count(*) n, max({AS_OF} - ts) age_s from kv_log group by strftime(make_timestamp(ts * 1000000), '%Y-%m-%d')"),
}
