"""The tables that the queries run on, derived from `events` as common table expressions in Spark SQL."""

from __future__ import annotations

import re

#: name -> Spark SQL; later ones may use earlier ones. {events} is the table of events.
TABLES = {
    "kv_log": """select event_id seq, concat('t', cast(event_id % 4 as string)) tenant_id, concat('k', cast(user_id % 40 as string)) key, props value,
      unix_timestamp(cast(ts as timestamp)) ts, case event_type when 'error' then 'delete' when 'signup' then 'repair' else 'write' end op,
      event_type = 'error' is_tombstone, concat('c', cast((event_id div 4) % 3 as string)) coord from {events}""",
    "five": "select cast(column_r as bigint) r from (values (0),(1),(2),(3),(4)) v(column_r)",
    "replica_rows": "select concat('n', cast(f.r as string)) node_id, k.* from kv_log k cross join five f where (k.seq * 7 + f.r * 3) % 11 <> 0",
    "replica_state": """select node_id, tenant_id, key, max_by(value, seq) value, max_by(is_tombstone, seq) is_tombstone, max(seq) seq, max_by(ts, seq) ts,
      count(case when coord='c0' then 1 end) c0, count(case when coord='c1' then 1 end) c1, count(case when coord='c2' then 1 end) c2
      from replica_rows group by node_id, tenant_id, key""",
    "nodes": "select * from (values ('n0','NORMAL',150),('n1','NORMAL',150),('n2','NORMAL',150),('n3','LEAVING',150),('n4','BOOTSTRAPPING',150)) v(node_id, state, virtual_nodes)",
    "tenants": "select * from (values ('t0',1,1),('t1',2,1),('t2',3,1),('t3',3,2)) v(tenant_id, replication_factor, version)",
    "ranges": """select * from (values ('r0','0000000000000000','4000000000000000'),('r1','4000000000000000','8000000000000000'),
      ('r2','c000000000000000','2000000000000000'),('r3','5000000000000000','5000000000000000')) v(range_id, lo, hi)""",
    "requests": """select event_id request_id, concat('t', cast(event_id % 4 as string)) tenant_id, concat('k', cast(user_id % 40 as string)) key, props value,
      case (event_id div 4) % 4 when 0 then '' when 1 then 'one' when 2 then 'quorum' else 'all' end consistency,
      case when event_id % 3 = 0 then null else sha2(concat(cast(user_id as string), '-', event_type), 256) end idempotency_key,
      unix_timestamp(cast(ts as timestamp)) ts from {events}""",
    "hints": """select concat('h', cast(event_id as string)) hint_id, concat('n', cast(event_id % 5 as string)) target_node_id,
      concat('t', cast(event_id % 4 as string)) tenant_id, concat('k', cast(user_id % 40 as string)) key, props value,
      unix_timestamp(cast(ts as timestamp)) created_at, event_id % 12 replay_count from {events} where event_type = 'error'""",
    "vnodes": "select n.node_id, n.state, cast(i.i as bigint) i, concat(n.node_id, '-vnode-', cast(i.i as string)) vnode_id, substr(sha2(concat(n.node_id, '-vnode-', cast(i.i as string)), 256), 1, 16) hash from nodes n cross join (select {range150} i) i",
    "ring": "select node_id, vnode_id, hash from vnodes where state in ('NORMAL','LEAVING')",
    "gauges": """select event_id id, 85 + event_id % 13 used, (user_id * 7 + event_id) % 200 est, (event_id % 10) * 20 + 1 avail, (event_id * 3) % 101 cpu, (event_id * 5) % 101 mem, (event_id * 11) % 96 disk,
      cast(event_id % 20 as double) / 100 err, event_id % 50 queued, event_id % 7 * 20 capacity, event_id % 5 active, event_id % 3 * 4 workers, event_id % 9 * 10 done, event_id % 4 failed, event_id % 12 rf,
      (event_id * 13 - 4000) * 10 port, case when event_id % 3 = 0 then null else event_id % 5 end asked_rf, case when event_id % 2 = 0 then null else 10 + event_id % 90 end asked_vnodes from {events}""",
    "codes": """select event_id id, case event_id % 16 when 0 then 'OK' when 1 then 'InvalidArgument' when 2 then 'OutOfRange' when 3 then 'Unauthenticated' when 4 then 'PermissionDenied' when 5 then 'NotFound'
      when 6 then 'AlreadyExists' when 7 then 'Aborted' when 8 then 'FailedPrecondition' when 9 then 'ResourceExhausted' when 10 then 'Unimplemented' when 11 then 'Unavailable' when 12 then 'DeadlineExceeded' when 13 then 'Internal' when 14 then 'DataLoss' else 'Unknown' end call_code,
      case event_id % 13 when 0 then 'OK' when 1 then 'INVALID_ARGUMENT' when 2 then 'KEY_TOO_LARGE' when 3 then 'VALUE_TOO_LARGE' when 4 then 'KEY_NOT_FOUND' when 5 then 'DISK_FULL' when 6 then 'DISK_THROTTLED' when 7 then 'CHECKSUM_FAILED' when 8 then 'CORRUPTED_DATA' when 9 then 'UNAVAILABLE' when 10 then 'INVALID_KEY' when 11 then 'RESOURCE_EXHAUSTED' else 'OTHER' end store_code,
      case user_id % 5 when 0 then 'Tenant t1 is not here' when 1 then 'no such key' when 2 then 'migration m1' when 3 then 'idempotency key in use' else 'nothing to say' end message, 1 + event_id % 4 attempt from {events}""",
    "pending": """select concat('p', cast(event_id as string)) change_id, case event_id % 3 when 1 then 'in_progress' else 'completed' end status, unix_timestamp(cast(ts as timestamp)) start_time,
      unix_timestamp(cast(ts as timestamp)) + 900 last_updated, case when event_id % 5 = 0 then null else unix_timestamp(cast(ts as timestamp)) + 600 end completed_at,
      case when event_id % 4 = 0 then 'streaming' else 'completed' end stream_state from {events} where event_type = 'signup'""",
    "pending_events": """select event_id seq, concat('p', cast((event_id - event_id % 3) as string)) change_id, case event_id % 7 when 0 then 'delete' when 1 then 'insert' else 'update' end op,
      case event_id % 2 when 0 then 'completed' else 'failed' end status, unix_timestamp(cast(ts as timestamp)) ts from {events}""",
    "node_events": """select event_id seq, concat('n', cast((event_id * event_id + user_id) % 12 as string)) node_id, case event_id % 5 when 0 then 'add' when 1 then 'remove' else 'state' end op,
      case event_id % 4 when 0 then 'NORMAL' when 1 then 'LEAVING' when 2 then 'DOWN' else 'BOOTSTRAPPING' end state from {events}""",
    "migrations": """select concat('m', cast(event_id as string)) migration_id, concat('n', cast(event_id % 5 as string)) node_id, case event_id % 2 when 0 then 'running' else 'completed' end status, user_id % 100 keys_migrated, (user_id % 3) * 100 total_keys,
      unix_timestamp(cast(ts as timestamp)) started_at, case when event_id % 2 = 0 then null else unix_timestamp(cast(ts as timestamp)) + user_id end completed_at from {events} where event_type = 'view'""",
    "stored": """select concat('idempotency:', tenant_id, ':', key, ':', idempotency_key) store_key, min(ts) + 50000 stored_at, concat('r', cast(min(request_id) as string)) answer
      from requests where idempotency_key is not null and request_id % 2 = 0 group by concat('idempotency:', tenant_id, ':', key, ':', idempotency_key)""",
    "keys": "select distinct tenant_id, key, substr(sha2(concat(tenant_id, ':', key), 256), 1, 16) hash from kv_log",
}


def prefix(sql: str, events: str, range150: str) -> str:
    """WITH of the tables that `sql` needs."""
    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in need:
                need.append(name)
                todo.append(TABLES[name])
    listed = ", ".join(f"{n} as ({TABLES[n]})" for n in TABLES if n in need).replace("{events}", events).replace("{range150}", range150)
    return f"with {listed} {sql}" if not sql.lstrip().lower().startswith("with ") else f"with {listed}, {sql.lstrip()[5:]}" if listed else sql


def spark_sql(spark, sf_dir: str, sql: str):
    found = prefix(sql, f"parquet.`{sf_dir}/events.parquet`", "explode(sequence(0, 149))")
    return spark.sql(found if not found.startswith("with  ") else sql)


def duck_sql(sql: str) -> str:
    """The same in DuckDB's words."""
    out = prefix(sql, "events", "unnest(range(150))")
    if out.startswith("with  "):
        out = sql
    if re.search(r"\b(chain|bucket) as \(", out):  # these name themselves
        out = out.replace("with ", "with recursive ", 1)
    for a, b in ((r"sha2\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 256\)", r"sha256(\1)"), (r"unix_timestamp\(cast\(ts as timestamp\)\)", "epoch_us(ts) // 1000000"), (r" div ", " // "), (r"octet_length\(", "strlen("), (r"regexp_like\(", "regexp_matches("), (r"percentile\(", "quantile_cont("), (r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"cast(count_if(\1) as bigint)")):
        out = re.sub(a, b, out)
    return out


def table(spark, sf_dir: str, name: str):
    return spark_sql(spark, sf_dir, f"select * from {name}")
