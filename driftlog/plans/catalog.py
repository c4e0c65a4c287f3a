"""The key-value queries by name: declarative ones as SQL text, which DuckDB runs too, and operators over DataFrames with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks, scalars
from ..operators import ring as rings
from ..operators import versions
from .fixtures import duck_sql, spark_sql, table

AS_OF = 1706659199
LATEST = "select tenant_id, key, max_by(value, seq) value, max_by(is_tombstone, seq) dead, max(seq) seq, max_by(ts, seq) ts from kv_log group by tenant_id, key"
OWNER = "select k.tenant_id, k.key, k.hash, coalesce((select min(hash) from ring r where r.hash >= k.hash), (select min(hash) from ring)) succ from keys k"

#: name -> SQL of both engines.
SQL: dict[str, str] = {
    # log and memtable
    "kv_latest": f"select tenant_id, key, value, dead, seq, ts from ({LATEST}) x",
    "kv_live_keys": f"select tenant_id, key, seq from ({LATEST}) x where not dead",
    "op_counts": "select op, count(*) n from kv_log group by op",
    "log_seq_assign": "select tenant_id, seq, cast(row_number() over (partition by tenant_id order by seq) as bigint) tenant_seq from kv_log",
    # sorted files
    "lww_by_timestamp": "select tenant_id, key, value, ts, seq from (select *, row_number() over (partition by tenant_id, key order by ts desc, seq) rn from kv_log) x where rn = 1",
    "sst_point_get": "select tenant_id, key, value, ts from (select *, row_number() over (order by ts desc, seq) rn from kv_log where tenant_id = 't1' and key = 'k7') x where rn = 1",
    "compaction_stats": f"select count(*) n_keys, count_if(dead) n_dropped, count_if(not dead) n_written from ({LATEST}) x",
    "compaction_plan": "select level, files, bytes, case when level = 0 then files >= 4 when level < 3 then bytes > 100000 else bytes > 100000 * power(10, level - 2) end compact from (select seq % 5 level, count(distinct seq div 1000) files, cast(sum(octet_length(value)) as bigint) bytes from kv_log group by seq % 5) x",
    "sst_manifest": "select seq % 5 level, min(concat(tenant_id, ':', key)) min_key, max(concat(tenant_id, ':', key)) max_key, count(*) n, cast(sum(octet_length(value)) as bigint) bytes from kv_log group by seq % 5",
    "file_prune": "select file, min_key, max_key from (select seq div 100 file, min(concat(tenant_id, ':', key)) min_key, max(concat(tenant_id, ':', key)) max_key from kv_log group by seq div 100) x where 't0:k10' between min_key and max_key",
    "manifest_ops": "select level, n from (select seq % 5 level, count(*) n from kv_log group by seq % 5 union all select 5 level, count(*) n from kv_log where seq % 5 < 2) x where level not in (0, 1)",
    "stream_keys_batches": "select key, cast((row_number() over (order by key) - 1) div 7 as bigint) batch from keys where tenant_id = 't2' and key between 'k1' and 'k3'",
    "has_key": f"select r.request_id from requests r where exists (select 1 from ({LATEST}) x where x.tenant_id = r.tenant_id and x.key = r.key and not x.dead)",
    "point_read_tiered": "select tenant_id, key, tier, seq from (select *, row_number() over (partition by tenant_id, key order by tier, seq desc) rn from (select *, case when seq % 5 = 0 then 0 when seq % 5 = 1 then 1 else 2 end tier from kv_log) y) x where rn = 1 and not is_tombstone",
    # hashes and ranges
    "key_hash": "select tenant_id, key, hash from keys",
    "composite_key": "select composite, substr(composite, 1, instr(composite, ':') - 1) tenant_id, substr(composite, instr(composite, ':') + 1) key from (select concat(tenant_id, ':', key, ':x') composite from keys) x",
    "hash_range_scan": "select k.seq, x.hash from kv_log k join keys x on k.tenant_id = x.tenant_id and k.key = x.key where x.hash >= 'c000000000000000' or x.hash < '2000000000000000'",
    "hash_range_scan_dedup": "select k.tenant_id, k.key, max(k.ts) ts, max(x.hash) hash from kv_log k join keys x on k.tenant_id = x.tenant_id and k.key = x.key where x.hash >= '4000000000000000' and x.hash < '8000000000000000' group by k.tenant_id, k.key",
    "ring_stats": "select node_id, count(*) n_vnodes from ring group by node_id",
    "ring_from_nodes": "select node_id, count(*) n from vnodes where state in ('NORMAL', 'LEAVING') group by node_id",
    "routable_nodes": "select node_id, state from nodes where state in ('NORMAL', 'BOOTSTRAPPING', 'LEAVING')",
    "authoritative_counts": "select count_if(state = 'NORMAL') authoritative, count(*) all_nodes from nodes",
    "list_nodes": "select node_id, state, virtual_nodes from nodes where state != 'DOWN' order by node_id",
    "removal_guard": "select node_id, n, n - 1 >= 3 allowed from nodes cross join (select count_if(state = 'NORMAL') n from nodes) x",
    "ranges_merge": "with h as (select hash, row_number() over (order by hash) rn, node_id from ring), g as (select hash, node_id, rn - row_number() over (partition by node_id order by hash) grp from h) select node_id, min(hash) first_hash, max(hash) last_hash, count(*) n from g group by node_id, grp",
    # quorum
    "tenant_enrich": "select r.request_id, r.tenant_id, t.replication_factor from requests r join tenants t on r.tenant_id = t.tenant_id",
    "quorum_write": "select k.seq, count(case when r.seq is not null then 1 end) acks, count(case when r.seq is not null then 1 end) >= 3 quorum_met from kv_log k left join replica_rows r on k.seq = r.seq group by k.seq",
    "idem_key_valid": "select request_id, coalesce(regexp_like(idempotency_key, '^[0-9a-f]{64}$'), false) valid from requests",
    "idem_store_key": "select request_id, concat('idempotency:', tenant_id, ':', key, ':', idempotency_key) store_key from requests where idempotency_key is not null",
    # hints
    "hint_count": "select target_node_id, count(*) n from hints group by target_node_id",
    "hint_totals": "select coalesce(target_node_id, 'all') node, count(*) n from hints group by rollup(target_node_id)",
    "hint_expiry": f"select hint_id from hints where {AS_OF} - created_at > 10800",
    "hint_ack": "select hint_id from hints where not (target_node_id = 'n1' and replay_count = 0)",
    "durable_hint_replay": "select hint_id, target_node_id, (row_number() over (partition by target_node_id order by created_at, hint_id) - 1) div 100 batch, case when target_node_id = 'n4' and replay_count >= 3 then 'dropped' when target_node_id = 'n4' then 'kept' else 'written' end outcome from hints",
    # validation
    "write_size": "select request_id, cast(floor((3 * (octet_length(tenant_id) + octet_length(key) + octet_length(value)) + 350) * 6 / 5.0) as bigint) bytes from requests",
    # cache
    "cache_stats": f"select cast(sum(octet_length(value) + octet_length(key)) as bigint) bytes, count(*) entries, cast(sum(octet_length(value) + octet_length(key)) as double) * 100 / 1048576 usage_pct from ({LATEST}) x",
    "cache_adjust": "select share, cast(case when share > 0.7 then 0.3 when share < 0.3 then 0.7 else 0.5 end as double) frequency_weight from (select avg(case when ts > 1705600000 then cast(1 as double) else cast(0 as double) end) share from kv_log) x",
    # operations
    "response_project": f"select concat(tenant_id, '/', key) id, case when dead then 'not_found' else 'ok' end status, case when dead then null else value end value from ({LATEST}) x",
    "latency_histogram": "select le, count(case when e.ms <= le then 1 end) n from (values (1),(10),(50),(100),(500)) b(le) cross join (select octet_length(value) ms from kv_log) e group by le",
    # movement
    "stream_progress": "select node_id, count(*) keys_copied, cast(sum(octet_length(value)) as bigint) bytes from replica_state group by node_id",
    "range_diff": "select a.tenant_id, a.key from (select tenant_id, key, seq from replica_state where node_id = 'n0') a full outer join (select tenant_id, key, seq from replica_state where node_id = 'n1') b on a.tenant_id = b.tenant_id and a.key = b.key where a.seq is null or b.seq is null or a.seq != b.seq",
    # metadata
    "meta_point_get": "select tenant_id, replication_factor, version from tenants where tenant_id = 't2'",
    "repair_targets": "select s.tenant_id, s.key, s.node_id from replica_state s join (select tenant_id, key, max_by(node_id, seq * 10 + cast(substr(node_id, 2, 1) as bigint)) winner from replica_state group by tenant_id, key) w on s.tenant_id = w.tenant_id and s.key = w.key where s.node_id != w.winner",
    "clock_max": "select node_id, tenant_id, key, greatest(c0, c1, c2) highest from replica_state",
    "clock_increment": "select seq, coord, count(*) over (partition by tenant_id, key, coord order by seq) tick from kv_log",
    "idempotent_first": "select request_id from (select request_id, row_number() over (partition by tenant_id, key, idempotency_key order by request_id) rn from requests where idempotency_key is not null) x where rn = 1",
}

NOT_N1, NOT_N2 = "node_id != 'n1'", "node_id != 'n2'"
RING_WITHOUT_N3 = "(select * from ring where node_id != 'n3')"
PAIRS = "from replica_state a join replica_state b on a.tenant_id = b.tenant_id and a.key = b.key and a.node_id < b.node_id"
_MORE, _LESS = "(a.c0 > b.c0 or a.c1 > b.c1 or a.c2 > b.c2)", "(a.c0 < b.c0 or a.c1 < b.c1 or a.c2 < b.c2)"
TENANTS_EDGE = "select * from (values ('ok', 't1'), ('empty', ''), ('colon', 'a:b'), ('long', repeat('x', 257)), ('null', cast(null as string))) v(id, t)"
BEATS = "(b.c0 >= a.c0 and b.c1 >= a.c1 and b.c2 >= a.c2 and (b.c0 > a.c0 or b.c1 > a.c1 or b.c2 > a.c2))"
_STATE = "select *, concat_ws(',', case when c0 > 0 then concat('c0=', cast(c0 as string)) end, case when c1 > 0 then concat('c1=', cast(c1 as string)) end, case when c2 > 0 then concat('c2=', cast(c2 as string)) end) clock from replica_state"
FRONTIER = f"select a.* from s a where not exists (select 1 from s b where a.tenant_id = b.tenant_id and a.key = b.key and {BEATS})"


#: The fold row by row: `chain` holds what counts after each replica of a key.
_NEXT_MORE, _NEXT_LESS = "(n.c0 > s.c0 or n.c1 > s.c1 or n.c2 > s.c2)", "(n.c0 < s.c0 or n.c1 < s.c1 or n.c2 < s.c2)"
_TAKE = f"({_NEXT_MORE} and (not {_NEXT_LESS} or n.ts > s.ts))"
FOLD_SQL = f"""with n as (select *, row_number() over (partition by tenant_id, key order by node_id) rn, count(*) over (partition by tenant_id, key) cnt from replica_state),
  chain as (select tenant_id, key, rn, cnt, node_id, ts, c0, c1, c2, false conflict from n where rn = 1
    union all select n.tenant_id, n.key, n.rn, n.cnt, case when {_TAKE} then n.node_id else s.node_id end, case when {_TAKE} then n.ts else s.ts end, case when {_TAKE} then n.c0 else s.c0 end,
      case when {_TAKE} then n.c1 else s.c1 end, case when {_TAKE} then n.c2 else s.c2 end, s.conflict or ({_NEXT_MORE} and {_NEXT_LESS}) from chain s join n on n.tenant_id = s.tenant_id and n.key = s.key and n.rn = s.rn + 1)
  select tenant_id, key, node_id, ts, concat_ws(',', case when c0 > 0 then concat('c0=', cast(c0 as string)) end, case when c1 > 0 then concat('c1=', cast(c1 as string)) end, case when c2 > 0 then concat('c2=', cast(c2 as string)) end) clock, conflict has_conflict from chain where rn = cnt"""


def _frontier(live: str) -> str:
    return f"with s as ({_STATE} {live}), f as ({FRONTIER}), w as (select *, row_number() over (partition by tenant_id, key order by ts desc, seq desc, node_id desc) rn, count(*) over (partition by tenant_id, key) nf from f), n as (select tenant_id, key, count(*) n_replicas from s group by tenant_id, key), m as (select tenant_id, key, count(distinct clock) n_maximal from f group by tenant_id, key) "


def _pairs(spark, d):
    s = _state(spark, d)
    a, b = s.select("tenant_id", "key", F.col("node_id").alias("na"), F.col("vc").alias("a")), s.select("tenant_id", "key", F.col("node_id").alias("nb"), F.col("vc").alias("b"))
    return a.join(b, ["tenant_id", "key"]).where("na < nb")


def _state(spark, d):
    return table(spark, d, "replica_state").withColumn("vc", versions.clock_of("c0", "c1", "c2"))


def _ring(spark, d):
    return rings.build(table(spark, d, "nodes"))


def _without(ring, node: str):
    return ring.where(F.col("node_id") != node)


def _compared(name: str, of):
    return lambda s, d: _pairs(s, d).select("tenant_id", "key", "na", "nb", of(F.col("a"), F.col("b")).alias(name))


def _replica_sql(count: int, ring: str = "ring") -> str:
    return f"""with owner as ({OWNER.replace("ring", ring)}), dist as (select o.tenant_id, o.key, r.node_id, min(concat(case when r.hash >= o.succ then '0' else '1' end, r.hash)) away from owner o cross join {ring} r group by o.tenant_id, o.key, r.node_id)
      select tenant_id, key, replica, rank from (select tenant_id, key, node_id replica, row_number() over (partition by tenant_id, key order by away) rank from dist) x where rank <= {count}"""


def _moved_sql(new: str, old: str) -> str:
    return f"""with n as (select node_id, vnode_id, hash, coalesce(lag(hash) over (order by hash), (select max(hash) from ring where {new})) lo from ring where {new}), o as (select node_id, hash from ring where {old})
      select n.vnode_id vnode, n.node_id to_node, o.node_id from_node, n.lo, n.hash hi from n join o on o.hash = coalesce((select min(hash) from o where o.hash >= n.hash), (select min(hash) from o)) where not ({old.replace('node_id', 'n.node_id')})"""


def _log_lines(spark, d):
    """Log lines as a store writes them; every 97th is damaged."""
    log = table(spark, d, "kv_log")
    fields = lambda crc: F.concat(F.lit('{"SequenceNumber":'), F.col("seq").cast("string"), F.lit(',"TenantID":"'), "tenant_id", F.lit('","Key":"'), "key", F.lit('","Value":"'), F.base64(F.col("value").cast("binary")), F.lit('","VectorClock":{"Entries":null},"Timestamp":'), F.col("ts").cast("string"), F.lit(',"OperationType":"'), "op", F.lit('","Checksum":'), crc, F.lit("}"))
    line = fields(F.crc32(fields(F.lit("0")).cast("binary")).cast("string"))
    return log.select(F.when(F.col("seq") % 97 == 0, F.regexp_replace(line, '"TenantID":"t', '"TenantID":"x')).otherwise(line).alias("line"))


def _write_edges(spark, d):
    return spark.sql(TENANTS_EDGE).select("id", F.col("t"), F.coalesce("t", F.lit("k")).alias("k"), F.lit("v").alias("v"))


#: name -> (Spark over DataFrame operators, SQL for DuckDB in Spark's words, or None).
OPERATORS = {
    "ring_build": (lambda s, d: _ring(s, d), "select node_id, vnode_id, hash from ring"),
    "ring_intervals": (lambda s, d: rings.intervals(_ring(s, d)), "select node_id, vnode_id, hash, coalesce(lag(hash) over (order by hash), (select max(hash) from ring)) prev from ring"),
    "ring_owner": (lambda s, d: rings.owners(table(s, d, "keys"), _ring(s, d)).select("tenant_id", "key", "hash", "vnode_id", "node_id"), f"select o.tenant_id, o.key, o.hash, r.vnode_id, r.node_id from ({OWNER}) o join ring r on r.hash = o.succ"),
    "replica_set": (lambda s, d: rings.replicas(table(s, d, "keys"), _ring(s, d), 3).select("tenant_id", "key", "replica", "rank"), _replica_sql(3)),
    "write_replicas": (lambda s, d: rings.replicas(table(s, d, "keys"), _ring(s, d), 2).select("tenant_id", "key", "replica", "rank"), _replica_sql(2)),
    "read_replicas": (lambda s, d: rings.replicas(table(s, d, "keys"), _ring(s, d), 1).select("tenant_id", "key", "replica", "rank"), _replica_sql(1)),
    "ranges_node_add": (lambda s, d: rings.moved(_ring(s, d), _without(_ring(s, d), "n3")), _moved_sql("true", "node_id != 'n3'")),
    "ranges_node_remove": (lambda s, d: rings.moved(_ring(s, d), _without(_ring(s, d), "n0")), _moved_sql("true", "node_id != 'n0'")),
    "bootstrap_plan": (lambda s, d: rings.moved(_ring(s, d), _without(_ring(s, d), "n2")).groupBy("from_node", "to_node").agg(F.count("*").alias("n_ranges")), f"select from_node, to_node, count(*) n_ranges from ({_moved_sql('true', NOT_N2)}) x group by from_node, to_node"),
    "decommission_plan": (lambda s, d: rings.moved(_ring(s, d), _without(_ring(s, d), "n1")).groupBy("from_node").agg(F.count("*").alias("n_ranges")), f"select from_node, count(*) n_ranges from ({_moved_sql('true', NOT_N1)}) x group by from_node"),
    "replica_moves": (lambda s, d: rings.replicas(table(s, d, "keys"), _ring(s, d), 2).select("tenant_id", "key", "replica").exceptAll(rings.replicas(table(s, d, "keys"), _without(_ring(s, d), "n3"), 2).select("tenant_id", "key", "replica")),
        f"select tenant_id, key, replica from ({_replica_sql(2)}) a except select tenant_id, key, replica from ({_replica_sql(2, RING_WITHOUT_N3)}) b"),
    "vnode_parse": (lambda s, d: table(s, d, "vnodes").select("vnode_id", scalars.vnode_node(F.concat(F.lit("a-vnode-"), "vnode_id")).alias("node")), "select vnode_id, concat('a-vnode-', node_id) node from vnodes"),
    "clock_compare": (_compared("cmp", clocks.compare), f"select a.tenant_id, a.key, a.node_id na, b.node_id nb, case when {_MORE} and {_LESS} then 'Concurrent' when {_MORE} then 'After' when {_LESS} then 'Before' else 'Identical' end cmp {PAIRS}"),
    "clock_compare3": (_compared("cmp", clocks.compare3), f"select a.tenant_id, a.key, a.node_id na, b.node_id nb, case when {_MORE} and {_LESS} then 0 when {_MORE} then 1 when {_LESS} then -1 else 0 end cmp {PAIRS}"),
    "clock_compare_node": (_compared("cmp", clocks.compare_node), f"select a.tenant_id, a.key, a.node_id na, b.node_id nb, case when {_MORE} and {_LESS} then 0 when {_MORE} then 1 when {_LESS} then -1 else 0 end cmp {PAIRS}"),
    "clock_equals": (_compared("same", clocks.equals), f"select a.tenant_id, a.key, a.node_id na, b.node_id nb, a.c0 = b.c0 and a.c1 = b.c1 and a.c2 = b.c2 same {PAIRS}"),
    "conflict_frontier": (lambda s, d: versions.frontier(_state(s, d)).select("tenant_id", "key", "n_maximal", "node_id", "seq", "clock"), _frontier("") + "select w.tenant_id, w.key, m.n_maximal, w.node_id, w.seq, w.clock from w join m on w.tenant_id = m.tenant_id and w.key = m.key where rn = 1"),
    "conflict_fold": (lambda s, d: versions.fold(_state(s, d), "node_id"), FOLD_SQL),
    "read_repair_rows": (lambda s, d: _state(s, d).withColumn("own", clocks.shown(F.col("vc"))).select("tenant_id", "key", F.col("node_id").alias("target"), "own").join(versions.frontier(_state(s, d)).where("n_maximal > 1").select("tenant_id", "key", "clock"), ["tenant_id", "key"]).where("own != clock").select("tenant_id", "key", "target", "clock"), _frontier("") + "select s.tenant_id, s.key, s.node_id target, w.clock from s join w on s.tenant_id = w.tenant_id and s.key = w.key and w.rn = 1 join m on m.tenant_id = s.tenant_id and m.key = s.key where m.n_maximal > 1 and s.clock != w.clock"),
    "quorum_read": (lambda s, d: versions.quorum_read(table(s, d, "requests"), table(s, d, "tenants"), _state(s, d)), _frontier("where not is_tombstone") + "select r.tenant_id, r.key, w.value, w.clock, least(coalesce(n.n_replicas, 0), t.replication_factor) replica_count, cast(t.replication_factor div 2 + 1 as bigint) required, least(coalesce(n.n_replicas, 0), t.replication_factor) >= t.replication_factor div 2 + 1 quorum_met, coalesce(m.n_maximal, 0) > 1 has_conflict, n.n_replicas is not null found from (select distinct tenant_id, key from requests) r join tenants t on r.tenant_id = t.tenant_id left join w on w.tenant_id = r.tenant_id and w.key = r.key and w.rn = 1 left join n on n.tenant_id = r.tenant_id and n.key = r.key left join m on m.tenant_id = r.tenant_id and m.key = r.key"),
    "compaction_merge": (lambda s, d: versions.compact(table(s, d, "kv_log")).select("tenant_id", "key", "value", "seq"), f"select tenant_id, key, value, seq from ({LATEST}) x where not dead"),
    "latency_summary": (lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99")), "select event_type, count(*) n, min(value) least, max(value) most, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.99), 6) p99 from events group by event_type"),
    "range_checksum": (lambda s, d: table(s, d, "replica_state").groupBy("node_id", "tenant_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.col("seq").cast("string")))), ","), 256).alias("digest")), "select node_id, tenant_id, sha256(string_agg(concat(key, '=', cast(seq as string)), ',' order by concat(key, '=', cast(seq as string)))) digest from replica_state group by node_id, tenant_id"),
    "log_integrity": (lambda s, d: _log_lines(s, d).select(F.crc32(F.regexp_replace("line", '"Checksum":[0-9]+}$', '"Checksum":0}').cast("binary")).alias("crc"), F.regexp_extract("line", '"Checksum":([0-9]+)}$', 1).cast("long").alias("own"), F.get_json_object("line", "$.SequenceNumber").cast("long").alias("seq")).agg(F.count_if(F.col("crc") == F.col("own")).alias("recovered"), F.count_if(F.col("crc") != F.col("own")).alias("skipped"), F.max("seq").alias("max_seq")), "select count_if(seq % 97 != 0) recovered, count_if(seq % 97 = 0) skipped, max(seq) max_seq from kv_log"),
    "crc32_rows": (lambda s, d: table(s, d, "kv_log").select("seq", F.crc32(F.col("value").cast("binary")).alias("crc")), None),
    "bloom_sizing": (lambda s, d: s.createDataFrame([(n, *scalars.bloom_size(n, 0.01)) for n in (1_000, 10_000, 1_000_000)], "n long, bits long, hashes long"), "select n, cast(ceil(-n * ln(0.01) / (ln(2) * ln(2))) as bigint) bits, cast(ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)) as bigint) hashes from (select cast(x as bigint) n from (values (1000), (10000), (1000000)) v(x)) y"),
    "validate_tenant": (lambda s, d: _write_edges(s, d).select("id", F.coalesce(scalars.tenant_error(F.col("t")), F.lit("")).alias("error")), "select * from (values ('ok', ''), ('empty', 'tenant_empty'), ('colon', 'tenant_colon'), ('long', 'tenant_too_long'), ('null', 'tenant_empty')) v(id, error)"),
    "validate_value": (lambda s, d: table(s, d, "requests").select("request_id", scalars.value_error(F.col("value"), 60).isNull().alias("valid")), "select request_id, octet_length(value) <= 60 valid from requests"),
    "validate_write": (lambda s, d: _write_edges(s, d).select("id", F.coalesce(scalars.write_error(F.col("t"), F.col("k"), F.col("v")), F.lit("")).alias("error")), "select * from (values ('ok', ''), ('empty', 'tenant_empty'), ('colon', 'tenant_colon'), ('long', 'tenant_too_long'), ('null', 'tenant_empty')) v(id, error)"),
}


def queries() -> dict:
    from . import store_queries

    plain = {name: (lambda s, d, q=sql: spark_sql(s, d, q)) for name, sql in SQL.items()}
    return plain | {name: f for name, (f, _) in (OPERATORS | store_queries.OPERATORS).items()}


def oracle_sql() -> dict[str, str]:
    from . import store_queries

    return {name: duck_sql(sql) for name, sql in SQL.items()} | {name: duck_sql(sql) for name, (_, sql) in (OPERATORS | store_queries.OPERATORS).items() if sql}
