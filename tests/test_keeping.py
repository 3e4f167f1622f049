"""Retention, quotas, cold objects, cache counters, verification and vectors."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import counter_rules
from fleetscope.operators import cache, retention, vectors, verify
from fleetscope.sources import cold_store, readers, writers

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("max_rows", [10_000, 2])
def test_fifo_is_per_session_and_cap_is_inclusive(spark, rows, max_rows):
    data = [("a", i, 10) for i in range(5)] + [("b", 0, 31), ("c", 0, 30)]
    chunks = spark.createDataFrame(data, "session_id string, seq long, size long")
    kept = retention.fifo_keep(chunks, 30, max_rows=max_rows).where("kept")
    assert rows(kept, "session_id", "seq") == [("a", 2), ("a", 3), ("a", 4), ("c", 0)]


@pytest.mark.parametrize("max_rows", [10_000, 3])
@pytest.mark.parametrize("mode, kept", [("evict", [3, 4, 5]), ("refuse", [0, 1])])
def test_tenant_quota(spark, rows, max_rows, mode, kept):
    sizes = [10, 10, 50, 10, 10, 10]
    data = [("t", f"s{i % 2}", i, size, T0 + timedelta(minutes=i)) for i, size in enumerate(sizes)] + [("u", "s9", 0, 1, T0)]
    chunks = spark.createDataFrame(data, "tenant_id string, session_id string, seq long, size long, ts timestamp")
    out = retention.tenant_fifo_keep(chunks, 40, over_quota=mode, max_rows=max_rows)
    assert out.count() == len(data)
    assert [s for t, s in rows(out.where("action = 'keep'"), "tenant_id", "seq") if t == "t"] == kept


def test_usage_leaves_out_foreign_keys(spark, rows):
    data = [("b", "tenant/t1/session/x.log", 5), ("b", "tenant/t1/session/y.log", 6), ("b", "tenant/t1/stray", 7), ("b", "other", 8)]
    owned = readers.with_object_owner(spark.createDataFrame(data, "bucket string, key string, size long"))
    assert owned.count() == 4
    assert rows(retention.tenant_usage(owned)) == [("t1", 2, 11)]
    assert rows(retention.usage(owned, "bucket")) == [("b", 4, 26)]


@pytest.mark.parametrize(
    "store, key, incomplete, days, closed, ttl, expired",
    [
        ("cold", "tenant/a", False, 90, None, 90, False),
        ("cold", "tenant/a", False, 91, None, 90, True),
        ("cold", "parked/a", False, 900, None, None, False),
        ("cold", "parked/a", True, 8, None, 7, True),
        ("blob", "screenshots/a", False, 91, None, 90, True),
        ("blob", "other", False, 900, None, None, False),
        ("cache", "k", False, 31, None, 30, True),
        ("cache", "k", True, 2, None, 1, True),
        ("logs", "k", False, 14, None, 14, False),
        ("warm", "k", False, 900, None, 7, False),
        ("warm", "k", False, 900, 8, 7, True),
        ("warm", "k", False, 900, 7, 7, False),
    ],
)
def test_expiry(spark, store, key, incomplete, days, closed, ttl, expired):
    ago = lambda d: None if d is None else T0 - timedelta(days=d)
    row = [(store, key, incomplete, ago(days), ago(closed))]
    table = spark.createDataFrame(row, "store string, key string, incomplete boolean, created timestamp, closed_at timestamp")
    got = retention.expire(table, F.lit(T0)).first()
    assert (got.ttl_days, got.expired) == (ttl, expired)


def test_tags(spark, rows):
    data = [("i", f"t{n}", f"id{n % 4}", T0 + timedelta(days=n)) for n in range(6)]
    tags = spark.createDataFrame(data, "image string, tag string, image_id string, created timestamp")
    live = spark.createDataFrame([("id1",)], "image_id string")
    assert rows(retention.keep_latest(tags), "tag") == [("t4",), ("t5",)]
    assert rows(retention.deletable_tags(tags, live), "tag") == [("t0",), ("t2",), ("t3",)]


@pytest.mark.parametrize("max_rows", [10_000, 5])
def test_cold_objects_are_whole_and_written_once(spark, tmp_path, max_rows):
    random.seed(7)
    bodies = {("t1", "s1"): 40, ("t1", "s2"): 3, ("t2", "s1"): 1}
    data = [(t, s, i, random.randbytes(random.randrange(1, 30)), T0) for (t, s), n in bodies.items() for i in range(n)]
    data.append(("t2", "open", 0, b"x", None))
    random.shuffle(data)
    schema = "tenant_id string, session_id string, seq long, bytes binary, closed_at timestamp"
    path = str(tmp_path / "cold")
    chunks = spark.createDataFrame(data, schema)
    assert cold_store.read_objects(spark, path).collect() == [] and cold_store.write(chunks, path, part_bytes=64, max_rows=max_rows) == 3
    late = spark.createDataFrame([("t1", "s2", 9, b"late", T0), ("t3", "new", 0, b"new", T0)], schema)
    assert cold_store.write(late, path, part_bytes=64) == 1
    got = {}
    for r in cold_store.read_objects(spark, path).orderBy("part_no").collect():
        got.setdefault((r.tenant_id, r.session_id), []).append(bytes(r.body))
        assert len(r.body) < 64 + 30 and r.object_key == f"tenant/{r.tenant_id}/session/{r.session_id}.log"
    want = {key: b"".join(row[3] for row in sorted(data, key=lambda r: r[2]) if row[:2] == key) for key in bodies}
    assert {k: b"".join(v) for k, v in got.items()} == want | {("t3", "new"): b"new"}
    manifest = {(r.tenant_id, r.session_id): r for r in cold_store.read_manifest(spark, path).collect()}
    assert manifest["t1", "s1"].chunks == 40 and set(manifest) == set(got)
    assert all(r.parts == len(got[k]) and r.size_bytes == sum(map(len, got[k])) for k, r in manifest.items())


def test_cold_objects_of_two_writers_at_once(spark, tmp_path):
    """Both stage before either commits: each session comes from the one that commits first, with all its parts."""
    path, schema = str(tmp_path / "cold"), "tenant_id string, session_id string, seq long, bytes binary, closed_at timestamp"
    rows = lambda names, byte: spark.createDataFrame([("t", n, i, byte * 10, T0) for n in names for i in range(3)], schema)
    first, second = (cold_store.stage(rows(n, b), path, part_bytes=15) for n, b in (("ab", b"1"), ("bc", b"2")))
    lost = cold_store.stage(rows("d", b"3"), path)  # its writer dies
    assert cold_store.read_manifest(spark, path).collect() == []
    assert cold_store.commit(spark, path, second) == 2 and cold_store.commit(spark, path, first) == 1
    assert cold_store.commit(spark, path, first) == 0 and cold_store.commit(spark, path, second) == 0
    objects = {}
    for r in cold_store.read_objects(spark, path).orderBy("part_no").collect():
        objects[r.session_id] = objects.get(r.session_id, b"") + bytes(r.body)
    assert objects == {"a": b"1" * 30, "b": b"2" * 30, "c": b"2" * 30}
    assert {r.session_id: r.parts for r in cold_store.read_manifest(spark, path).collect()} == {"a": 2, "b": 2, "c": 2}
    assert not cold_store._put_record(spark, path, 1, lost) and cold_store._put_record(spark, path, 2, f"{lost}-2")


DOCS = {
    "nested": '{"stats": {"compile_requests": 5.7, "cache_hits": {"counts": {"rust": 8, "c": "x", "d": 1.9}}, "cache_misses": {"counts": {"rust": 2}}}}',
    "flat": '{"compile_requests": "7", "cache_hits": {"counts": {}}, "cache_misses": {"adv_counts": {"a": 1}}}',
    "odd": '{"stats": null, "compile_requests": 3}',
    "bad": "no json",
}


def test_counters_from_files(spark, tmp_path):
    for name, text in DOCS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(json.loads(text), indent=1) if name != "bad" else text)
    out = cache.flatten_counters(readers.scan_cache_stats(spark, str(tmp_path)))
    got = {r.host: (r.compile_requests, r.cache_hits, r.cache_misses, r.cache_errors) for r in out.collect()}
    assert got == {"nested": (5, 9, 2, None), "flat": (None, 0, 0, None), "odd": (None,) * 4, "bad": (None,) * 4}
    rate = {r.host: (r.hit_rate, r.passes) for r in cache.hit_rate(out, "host").collect()}
    assert rate["nested"] == (pytest.approx(9 / 11), True) and rate["flat"] == (None, None)


@pytest.mark.parametrize("hits, misses, passes", [(80, 20, True), (79, 21, False), (0, 0, None)])
def test_gate(spark, hits, misses, passes):
    table = spark.createDataFrame([(hits, misses)], "cache_hits long, cache_misses long")
    assert cache.hit_rate(table).first().passes is passes


def test_exposition(spark, tmp_path):
    names = [*fv.SCALAR_COUNTERS, *fv.MAP_COUNTERS]
    counters = spark.range(1).select(F.lit("h").alias("owner"), *[F.lit(None).cast("bigint").alias(n) for n in names])
    counters = counters.withColumn("cache_hits", F.lit(4).cast("bigint"))
    buckets = spark.createDataFrame([("h", "store", 3, None)], "owner string, bucket string, objects long, size_bytes long")
    out = cache.exposition_rows(counters, buckets)
    want = [
        "# HELP sccache_bucket_objects Object count in the shared sccache MinIO bucket.",
        "# TYPE sccache_bucket_objects gauge",
        'sccache_bucket_objects{bucket="store"} 3',
        "# TYPE sccache_local_cache_hits_total counter",
        "sccache_local_cache_hits_total 4",
    ]
    assert [r.line for r in out.orderBy("line_no").collect()] == want
    writers.write_exposition(out, str(tmp_path / "text"))
    assert [r.line for r in spark.read.parquet(str(tmp_path / "text")).orderBy("owner", "line_no").collect()] == want


@pytest.mark.parametrize("text, want", [("", (0, 0)), ('{"objects":1,"size":2}\n\n{"objects":3,"size":4}\n \n', (3, 4)), ('{"size":4}', (0, 4))])
def test_bucket_root(spark, text, want):
    assert tuple(spark.range(1).select(readers.bucket_root(F.lit(text))).first()[0]) == want


@pytest.mark.parametrize("text", ['{"objects":1,"size":2}\n{"objects":3', "mc: error", '{"objects":1\n{"objects":2,"size":3}'])
def test_a_broken_listing_is_unknown_not_empty(spark, text):
    assert spark.range(1).select(readers.bucket_root(F.lit(text))).first()[0] is None


def test_counters_keep_every_digit(spark):
    doc = '{"a":{"counts":{"x":9007199254740993,"y":2.5,"z":"4"}},"b":{"counts":[1,2]},"c":{},"d":{"counts":null},"n":9007199254740993}'
    flat = counter_rules.flat_counters(F.try_parse_json(F.lit(doc)))
    totals = [counter_rules.counter_total(flat, name) for name in "abcde"]
    got = spark.range(1).select(*totals, counter_rules.scalar_counter(flat, "n")).first()
    assert tuple(got) == (9007199254740995, None, 0, 0, None, 9007199254740993)


def test_reconcile(spark, rows):
    left = spark.createDataFrame([("same", 2), ("less", 2), ("gone", 2), ("both", None)], "table_name string, n long")
    right = spark.createDataFrame([("same", 2), ("less", 1), ("both", None)], "table_name string, n long")
    got = dict(rows(verify.reconcile_counts(left, right), "table_name", "status"))
    assert got == {"same": "OK", "less": "MISMATCH", "gone": "MISMATCH", "both": "UNKNOWN"}
    assert rows(verify.table_counts({"x": left, "y": right})) == [("x", 4), ("y", 3)]


def test_revision_status(spark, rows):
    revs = [("one", "a", None), ("one", "b", "a"), ("two", "a", None), ("two", "b", "a"), ("two", "c", "a"), ("old", "a", None), ("old", "b", "a"), ("new", "a", None)]
    stamps = [("one", "b"), ("two", "b"), ("old", "a"), ("new", "")]
    table = spark.createDataFrame(revs, "db string, revision string, parent string")
    out = verify.revision_status(table, spark.createDataFrame(stamps, "db string, revision string"))
    assert rows(out) == [("new", 1, False), ("old", 1, False), ("one", 1, True), ("two", 2, False)]
    bad = spark.createDataFrame([("A@x",), ("b@x",)], "email string")
    assert rows(verify.email_violations(bad)) == [("A@x",)]


@pytest.mark.parametrize("block", [1000, 2])
def test_neighbours_against_numpy(spark, block):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(60)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    wanted = [(q, rng.normal(size=6).tolist()) for q in range(5)]
    queries = spark.createDataFrame(wanted, "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit(np.array([w[1] for w in wanted])) @ unit(np.array([d[1] for d in data], dtype="float32").astype("float64")).T
    want = {(q, int(v)) for q in range(5) for v in np.argsort(-score[q])[:4]}
    out = vectors.nearest_neighbours(table, queries, 4, block=block)
    assert {(r.query_id, r.vec_id) for r in out.collect()} == want
    centre = {r.query_id: r.embedding for r in vectors.centroids(table, "label").collect()}
    assert centre[0] == pytest.approx(np.mean([d[1] for d in data if d[2] == 0], axis=0), abs=1e-6)


def test_table_from_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert readers.scan_table(spark, str(tmp_path / "t")).count() == 3
    spark.createDataFrame([("b", "tenant/t/session/s.log", 1, T0)], "bucket string, key string, size long, created timestamp").write.parquet(str(tmp_path / "inv"))
    assert readers.scan_inventory(spark, str(tmp_path / "inv")).first().session_id == "s"
