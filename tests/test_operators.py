"""Hand vectors and properties of the key-value operators."""

import zlib

import pytest
from pyspark.sql import functions as F

from driftlog import store
from driftlog.functions import clocks, scalars
from driftlog.operators import ring, versions
from driftlog.sources import log as logs
from driftlog.streaming import streams

CLOCKS = [
    ({}, {}, "Identical", 0, 0, True), ({"a": 1}, {"a": 1}, "Identical", 0, 0, True), ({"a": 1}, {"a": 2}, "Before", -1, -1, False),
    ({"a": 2, "b": 1}, {"a": 1}, "After", 1, 1, False), ({"a": 1}, {"b": 1}, "Concurrent", 0, 0, False), ({"a": 0}, {}, "Identical", 0, 1, False),
    ({}, {"a": 0}, "Identical", 0, 0, False), ({"a": 1, "b": 2}, {"a": 1, "b": 1, "c": 1}, "Concurrent", 0, 0, False),
]


def test_clocks(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CLOCKS)], "i int, a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", clocks.compare(a, b), clocks.compare3(a, b), clocks.compare_node(a, b), clocks.equals(a, b)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(c[2:]) for c in CLOCKS]
    again = df.select((clocks.shown(clocks.merge(a, b)) == clocks.shown(clocks.merge(b, a))).alias("x")).distinct().collect()
    assert [r.x for r in again] == [True]


def test_fold_depends_on_order_and_frontier_does_not(spark):
    x, y, z = {"a": 1}, {"b": 1}, {"a": 1, "b": 1}
    found = {}
    for order in ("xyz", "zxy", "yzx"):
        rows = [("t", "k", i, 0, n, {"x": x, "y": y, "z": z}[n], i, "v", False) for i, n in enumerate(order)]
        df = spark.createDataFrame(rows, "tenant_id string, key string, arrival int, ts bigint, node_id string, vc map<string,bigint>, seq int, value string, is_tombstone boolean")
        folded = versions.fold(df, "arrival").first()
        top = versions.frontier(df).first()
        found[order] = (folded["node_id"], folded["has_conflict"], top["node_id"], top["n_maximal"])
    assert found == {"xyz": ("z", True, "z", 1), "zxy": ("z", False, "z", 1), "yzx": ("z", False, "z", 1)}


@pytest.mark.parametrize("data,crc", [(b"", 0), (b"hello world", 222957957), (bytes([0, 1, 2, 3, 255]), 2067134552), (bytes(10_000), 1295764014)])
def test_crc(spark, data, crc):
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    got = df.select(F.crc32("d"), scalars.crc_frame(F.col("d")), scalars.crc_valid(scalars.crc_frame(F.col("d"))), scalars.crc_valid(F.concat(F.lit(bytearray(b"x")), scalars.crc_frame(F.col("d"))))).first()
    assert (got[0], bytes(got[1]), got[2], got[3]) == (crc, data + zlib.crc32(data).to_bytes(4, "little"), True, False)


def test_ring(spark):
    df = spark.createDataFrame([("t:k",)], "k string")
    assert df.select(scalars.ring_hash(F.col("k"))).first()[0] == "21da45492b9a16b3"
    nodes = spark.createDataFrame([(f"n{i}", "NORMAL", 20) for i in range(4)], "node_id string, state string, virtual_nodes int")
    whole = ring.build(nodes)
    keys = spark.range(300).select(F.col("id").cast("string").alias("key"), scalars.ring_hash(F.col("id").cast("string")).alias("hash"))
    got = {(r.key, r.rank): r.replica for r in ring.replicas(keys, whole, 3).collect()}
    places = sorted((r.hash, r.node_id) for r in whole.collect())
    for r in keys.collect():
        at = next((i for i, p in enumerate(places) if p[0] >= r.hash), 0)
        walk = list(dict.fromkeys(places[(at + j) % len(places)][1] for j in range(len(places))))[:3]
        assert [got[r.key, i + 1] for i in range(3)] == walk
    less = {r.key: r.node_id for r in ring.owners(keys, whole.where("node_id != 'n1'")).collect()}
    assert all(less[k] == v for (k, rank), v in got.items() if rank == 1 and v != "n1")


def test_store_and_files(spark, tmp_path):
    log = spark.createDataFrame([(1, "t", "a", "1", 5, "write", False), (2, "t", "b", "2", 5, "write", False)], "seq long, tenant_id string, key string, value string, ts long, op string, is_tombstone boolean")
    log = store.put(log, spark.createDataFrame([(3, "t", "a", "3", 6), (4, "", "z", "3", 6)], "seq long, tenant_id string, key string, value string, ts long"))
    log = store.delete(log, spark.createDataFrame([(5, "t", "b", 7)], "seq long, tenant_id string, key string, ts long"))
    assert [r.value for r in store.get(log, "t", "a").collect()] == ["3"] and store.get(log, "t", "b").count() == 0
    assert {(r.key, r.value) for r in store.compact(log).collect()} == {("a", "3")} and store.compact(log, whole=False).count() == 2
    assert [r.key for r in store.scan_range(log, "t", "a", "z").collect()] == ["a"]
    lines = str(tmp_path / "log")
    logs.write_lines(log.where("value is not null"), lines)
    back = logs.read_lines(spark, lines)
    assert back.where("valid").count() == 3 and {bytes(r.value) for r in back.collect()} == {b"1", b"2", b"3"}
    logs.write_snapshot(log, str(tmp_path / "snap"), 2)
    assert sum(r.n for r in logs.manifest(spark, str(tmp_path / "snap")).collect()) == 4


def test_stream_equals_batch(spark, tmp_path):
    log = spark.range(200).select(F.col("id").alias("seq"), F.lit("t").alias("tenant_id"), (F.col("id") % 17).cast("string").alias("key"), F.timestamp_seconds("id").alias("event_time"), (F.col("id") % 50).cast("string").alias("store_key"))
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    ranges = spark.createDataFrame([("r", "c000000000000000", "2000000000000000"), ("e", "5", "5")], "range_id string, lo string, hi string")
    out = str(tmp_path / "out")
    stream = streams.forwarded(streams.tail(spark, str(tmp_path / "log"), log.schema, 2), ranges)
    streams.run_available(stream.select("seq", "range_id"), str(tmp_path / "cp"), lambda df, i: df.write.mode("append").parquet(out))
    want = {(r.seq, r.range_id) for r in streams.forwarded(log, ranges).collect()}
    assert {(r.seq, r.range_id) for r in spark.read.parquet(out).collect()} == want and want
    once = str(tmp_path / "once")
    streams.run_available(streams.taken_once(streams.tail(spark, str(tmp_path / "log"), log.schema)).select("store_key"), str(tmp_path / "cp2"), lambda df, i: df.write.mode("append").parquet(once))
    assert spark.read.parquet(once).count() == 50
