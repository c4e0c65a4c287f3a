"""Rules, coordinators, metadata and stateful streams of the store, by hand."""

import pytest
from pyspark.sql import functions as F

from driftlog import store
from driftlog.functions import bloom, clocks, rules
from driftlog.operators import hints, metadata, ring, scans, versions
from driftlog.plans import catalog
from driftlog.sources import log as logs
from driftlog.streaming import stateful, streams


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("status,progress,ended,normal,verdict", [
    ("in_progress", {"a": "completed"}, 30, 3, "not completed"), ("completed", {"a": "completed", "b": "streaming"}, 30, 3, "streaming still active"), ("completed", {"a": "completed"}, 1, 3, "grace period not elapsed"),
    ("completed", {"a": "completed"}, 24, 3, "safe"), ("completed", {}, 25, 3, "safe"), ("completed", {"a": "completed"}, 25, 2, "quorum not met"),
])
def test_cleanup(spark, status, progress, ended, normal, verdict):
    rows = spark.createDataFrame([(status, progress, 0, 0, normal)], "status string, progress map<string,string>, completed_at long, updated_at long, normal int")
    assert rows.select(rules.cleanup_verdict(*[F.col(c) for c in ("status", "progress", "completed_at", "updated_at")], F.lit(ended * 3600), F.col("normal"))).first()[0] == verdict


@pytest.mark.parametrize("text,most,want", [("a:b\x00 ", 256, "ab"), ("éé", 3, "é"), ("é€", 4, "é"), ("a\U0001f600b", 4, "a"), ("a\U0001f600b", 5, "a\U0001f600"), ("abc", 2, "ab"), (" \t ", 9, "")])
def test_sanitize(spark, text, most, want):
    assert one(spark, rules.sanitize_tenant(F.lit(text), most)) == want


def test_sanitize_key_keeps_tabs_inside(spark):
    assert one(spark, rules.sanitize_key(F.lit("\n a\tb:\x07c \n"), 1024)) == "a\tb:c"


def test_states_and_codes(spark):
    allowed = [(a, b) for a in rules.NEXT_STATES for b in rules.NEXT_STATES if one(spark, rules.state_allowed(F.lit(a), F.lit(b)))]
    assert allowed == [("BOOTSTRAPPING", "NORMAL"), ("BOOTSTRAPPING", "DOWN"), ("NORMAL", "LEAVING"), ("NORMAL", "DOWN"), ("LEAVING", "DOWN"), ("DOWN", "BOOTSTRAPPING")]
    assert [one(spark, rules.required(F.lit("quorum"), F.lit(n))) for n in (1, 3, 5, 7)] == [1, 2, 3, 4]
    assert one(spark, rules.api_code(F.lit("NotFound"), F.lit("no such TENANT key"))) == "TENANT_NOT_FOUND" and one(spark, rules.http_status(F.lit("?"))) == 500
    clock = lambda **x: F.create_map(*[F.lit(v) for p in x.items() for v in p])
    assert one(spark, rules.clock_error(clock(a=1))) is None and one(spark, rules.clock_error(clock(a=-1))) == "clock_negative"


def test_range_share(spark):
    share = lambda lo, hi: one(spark, rules.range_share(F.lit(lo * 16), F.lit(hi * 16)))
    assert share("0", "8") == pytest.approx(8 / 15) and share("8", "0") == pytest.approx(7 / 15) and share("3", "3") == 0


def test_bloom(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    made = bloom.build(keys, "k", 500, 0.01)
    kept = bloom.might_contain(spark.range(5_000).select(F.col("id").cast("string").alias("k")), "k", made, 500, 0.01)
    got = {int(r.k) for r in kept.collect()}
    assert set(range(500)) <= got and len(got) < 500 + 4_500 * 0.03


def test_running_total_does_not_depend_on_the_split(spark):
    rows = spark.range(1_000).select((F.col("id") * 7919 % 1000).alias("place"), (F.col("id") % 5 + 1).alias("w"))
    before = {}
    for r in sorted(rows.collect()):
        before[r.place] = before.get("sum", 0)
        before["sum"] = before[r.place] + r.w
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = scans.running(rows, "place", weight=F.col("w")).collect()
            assert all(before[r.place] == r.before for r in got) and len(got) == 1_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert scans.running(rows.where("false"), "place").count() == 0


def test_pages_follow_each_other(spark):
    live = spark.createDataFrame([("t", f"k{i:02}") for i in range(25)], "tenant_id string, key string")
    seen, first = [], "k03"
    while first is not None:
        page = store.page(live, "t", first, "k20", 7).collect()
        seen += [r.key for r in page]
        assert all(r.has_more == (r.next_key is not None) for r in page)
        first = page[0].next_key
    assert seen == [f"k{i:02}" for i in range(3, 21)]


def test_ring_with_few_nodes_and_one_that_holds_a_run(spark):
    """A node whose virtual nodes stand together makes the look-ahead grow; fewer nodes than replicas give them all."""
    places = [("a", i) for i in range(60)] + [("b", 60), ("c", 61)]
    made = spark.createDataFrame([(n, f"{n}-vnode-{i}", f"{i:016x}") for n, i in places], "node_id string, vnode_id string, hash string")
    got = {}
    for r in ring.successors(made, 3).collect():
        got.setdefault(r.vnode_id, {})[r["rank"]] = r.replica
    assert got["a-vnode-0"] == {1: "a", 2: "b", 3: "c"} and got["c-vnode-61"] == {1: "c", 2: "a", 3: "b"} and len(got) == 62
    assert {r.replica for r in ring.successors(made.where("node_id = 'b'"), 3).collect()} == {"b"}


def test_merge_by_clocks(spark):
    rows = [("t", "k", {"a": 1}, 9, 1, "old", False), ("t", "k", {"a": 2}, 5, 2, "new", False), ("t", "k", {"b": 1}, 7, 3, "beside", False), ("t", "x", {"a": 1}, 1, 4, "v", False), ("t", "x", {"a": 2}, 1, 5, None, True)]
    files = spark.createDataFrame(rows, "tenant_id string, key string, vc map<string,bigint>, ts long, seq long, value string, is_tombstone boolean")
    assert [(r.key, r.value) for r in versions.merge(files).collect()] == [("k", "beside")]
    assert {(r.key, r.is_tombstone) for r in versions.merge(files, whole=False).collect()} == {("k", False), ("x", True)}


def test_metadata(spark):
    nodes = spark.createDataFrame([("a", "NORMAL", 1), ("b", "LEAVING", 1)], "node_id string, state string, virtual_nodes int")
    changes = spark.createDataFrame([(1, "a", "state", "LEAVING"), (2, "b", "state", "NORMAL"), (3, "c", "add", None), (4, "d", "state", "NORMAL")], "seq long, node_id string, op string, state string")
    assert {(r.node_id, r.state) for r in metadata.apply_nodes(nodes, changes).collect()} == {("a", "LEAVING"), ("b", "LEAVING"), ("c", "BOOTSTRAPPING")}
    tenants = spark.createDataFrame([("x", 3, 1)], "tenant_id string, replication_factor int, version int")
    more = spark.createDataFrame([("x", 5, 1), ("y", 2, 1)], "tenant_id string, replication_factor int, version int")
    assert {(r.tenant_id, r.replication_factor) for r in metadata.insert(tenants, more, "tenant_id").collect()} == {("x", 3), ("y", 2)}
    assert [r.tenant_id for r in metadata.refused(tenants, more, "tenant_id").collect()] == ["x"]
    put = metadata.put(tenants, more.withColumn("seq", F.lit(1)), "tenant_id", "seq")
    assert {(r.tenant_id, r.replication_factor) for r in put.collect()} == {("x", 5), ("y", 2)}


def test_hint_round(spark):
    held = spark.createDataFrame([("h1", "n1", 0, 0), ("h2", "n2", 900, 8), ("h3", "n2", 900, 9), ("h4", "n1", 900, 0)], "hint_id string, target_node_id string, created_at long, replay_count long")
    up = spark.createDataFrame([("n1",)], "node_id string")
    got = hints.replay(held, up, 1000, ttl=500)
    assert {r.hint_id: (r.outcome, r.replay_count) for r in got.collect()} == {"h1": ("expired", 0), "h2": ("kept", 9), "h3": ("dropped", 10), "h4": ("replayed", 0)}
    assert [(r.hint_id, r.replay_count) for r in hints.settled(held, got).collect()] == [("h2", 9)]


def _streamed(spark, rows, schema, tmp_path, make):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out")
        stream = make(streams.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
        streams.run_available(stream, str(tmp_path / "cp"), lambda df, i: df.write.mode("append").parquet(out))
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_hints_as_a_stream(spark, tmp_path):
    event = lambda seq, ts, kind, hint=None: ("n1", ts, seq, kind, hint)
    first = [event(1, 1, "hint", "h1"), event(2, 2, "down"), event(3, 3, "hint", "h2"), event(4, 4, "hint", "h3"), event(5, 5, "hint", "h4")]
    then = [event(6, 102, "down"), event(7, 103, "down"), event(8, 106, "hint", "h5"), event(9, 107, "up")]
    got = _streamed(spark, [first, then], "target_node_id string, ts long, seq long, kind string, hint_id string", tmp_path, lambda s: stateful.replayed_hints(s, ttl=100, retries=2, most=2))
    assert set(got) == {("h1", "n1", "replayed"), ("h2", "n1", "full"), ("h3", "n1", "dropped"), ("h4", "n1", "dropped"), ("h5", "n1", "replayed")}


def test_limiter_as_a_stream(spark, tmp_path):
    rows = [[("t", 10, i) for i in range(4)], [("t", 11, 4), ("t", 11, 5)]]
    got = _streamed(spark, rows, "tenant_id string, ts long, request_id long", tmp_path, stateful.limited)
    assert {r[0]: r[2] for r in got} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}


def test_accepted_as_a_stream(spark, tmp_path):
    rows = [[("a", t, i) for i, t in enumerate((100, 105, 111))], [("a", 112, 3), ("b", 112, 4)]]
    make = lambda s: stateful.accepted(s.withColumn("event_time", F.timestamp_seconds("ts")), 10)
    got = _streamed(spark, rows, "store_key string, ts long, request_id long", tmp_path, make)
    assert {r[0] for r in got} == {0, 2, 4}


def test_registry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    held = streams.Registry(spark)
    frame = streams.tail(spark, str(tmp_path / "in"), "id long")
    held.add("copy", frame, str(tmp_path / "cp"), lambda df, i: None)
    with pytest.raises(ValueError):
        held.add("copy", frame, str(tmp_path / "cp2"), lambda df, i: None)
    assert held.names() == ["copy"] and held.get("copy").isActive
    held.remove("copy")
    with pytest.raises(KeyError):
        held.get("copy")


def test_damaged_files_are_passed_by(spark, tmp_path):
    log = spark.createDataFrame([(1, "t", "a", "1", 5, "write")], "seq long, tenant_id string, key string, value string, ts long, op string")
    logs.write_lines(log, str(tmp_path / "log"))
    (tmp_path / "log" / "part-9.txt").write_text('{"SequenceNumber":2,"TenantID":"t"\nnot a line\n')
    assert logs.read_lines(spark, str(tmp_path / "log") + "/part-*").where("valid").count() == 1


def test_repairs_are_taken_as_they_are(spark):
    log = spark.createDataFrame([(1, "t", "a", "1", 5, "write", False)], "seq long, tenant_id string, key string, value string, ts long, op string, is_tombstone boolean")
    now = store.repair(log, spark.createDataFrame([(2, "", "a", "2", 6)], "seq long, tenant_id string, key string, value string, ts long"))
    assert now.count() == 2 and now.where("op = 'repair'").first().value == "2"


@pytest.mark.parametrize("name", ["replica_set", "hash_in_ranges", "live_forward", "write_replicas"])
def test_plans_have_no_nested_loop_of_keys(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_clock_shown(spark):
    assert one(spark, clocks.shown(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == "a=2,b=1"
