"""Streams over several micro-batches give what the batch form gives."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import health, metrics
from fleetscope.operators.claims import live_claims
from fleetscope.session import small_table
from fleetscope.streaming import flows, stateful

T0 = datetime(2024, 1, 1)


def source(spark, folder, batches, schema):
    """A stream that takes one of ``batches`` per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"batch={i:03d}"))
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


def split(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


POINT = "series string, ts timestamp, value double"
SPEC = ("a", "ns", "m", ["d"], "min", 60, 3, "<", 1.0, "breaching", True)


def test_alarm_stream_equals_batch(spark, tmp_path):
    """Low values, gaps within and between batches, and a series that goes silent."""
    random.seed(9)
    rows = []
    for minute in range(120):
        for series in ("d=1", "d=2", "d=3"):
            if series == "d=3" and minute > 40:
                continue
            if random.random() < 0.6:
                rows.append((series, T0 + timedelta(minutes=minute, seconds=5), random.choice([0.0, 5.0, 5.0])))
    rules = small_table(spark, [SPEC], fv.ALARM_COLUMNS)
    points = source(spark, tmp_path, split(rows, 6), POINT).withColumn("alarm", F.lit("a"))
    periods = flows.metric_windows(points, ["alarm", "series"], 60, "min", "2 minutes")
    got = flows.run_available(stateful.alarm_stream(periods, rules), "alarms")
    last = max(r[1] for r in rows) - timedelta(minutes=2)
    closed = last.replace(second=0)
    batch = spark.createDataFrame(rows, POINT).select(
        F.lit("a").alias("alarm"), "series", F.date_trunc("minute", "ts").alias("period_start"), "value"
    )
    filled = metrics.fill_missing(batch.where(F.col("period_start") < F.lit(closed)), rules, until=F.lit(closed))
    want = metrics.alarm_transitions(metrics.evaluate_alarm(filled, rules))
    columns = ["series", "period_start", "state", "previous", "notify_ok"]
    expected = sorted(map(tuple, want.select(*columns).collect()))
    assert len(expected) > 5 and any(e[0] == "d=3" and e[1] > T0 + timedelta(minutes=41) for e in expected)
    assert sorted(map(tuple, got.select(*columns).collect())) == expected


def test_alarm_stream_judges_series_that_never_publish(spark, tmp_path):
    specs = [SPEC, ("b", "ns", "m", ["d"], "sum", 60, 2, ">=", 5.0, "notBreaching", False)]
    rules = small_table(spark, specs, fv.ALARM_COLUMNS)
    rows = [("d=1", T0 + timedelta(minutes=m, seconds=1), 9.0 if m in (3, 4, 5, 30) else 0.5) for m in (3, 4, 5, 6, 9, 30, 59)]
    points = source(spark, tmp_path, split(rows, 3), POINT).crossJoin(spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(alarm)"))
    periods = flows.metric_windows(points, ["alarm", "series"], 60, "min", "1 minute")
    silent = spark.createDataFrame([("a", "d=7"), ("b", "d=7"), ("a", "d=1")], "alarm string, series string")
    since, until = F.lit(T0 + timedelta(minutes=2)), F.lit(T0 + timedelta(minutes=58))
    got = flows.run_available(stateful.alarm_stream(periods, rules, silent, since), "alarms")
    batch = spark.createDataFrame(rows, POINT).crossJoin(spark.createDataFrame([("a",), ("b",)], "alarm string"))
    batch = batch.select("alarm", "series", F.date_trunc("minute", "ts").alias("period_start"), "value").where(F.col("period_start") < until)
    declared = batch.where("alarm = 'a' OR series = 'd=7'"), batch.where("alarm = 'b' AND series <> 'd=7'")
    want = metrics.fill_missing(declared[0], rules, since, until, silent).unionByName(metrics.fill_missing(declared[1], rules, until=until))
    want = metrics.alarm_transitions(metrics.evaluate_alarm(want, rules))
    columns = ["alarm", "series", "period_start", "value", "state", "previous", "notify_ok"]
    expected = sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert ("a", "d=7", T0 + timedelta(minutes=4), None, "ALARM", "OK", True) in expected and {e[0] for e in expected} == {"a", "b"}
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == expected


def test_alarm_runs_equal_a_loop_over_periods():
    draw = random.Random(3)
    for _ in range(300):
        last, n, run, missing = draw.randrange(1, 25), draw.randrange(1, 5), draw.randrange(6), draw.random() < 0.5
        at = np.array(sorted(draw.sample(range(1, last + 1), draw.randrange(last + 1))), np.int64)
        breach = np.array([draw.random() < 0.5 for _ in at], bool)
        count, state, want = run, run >= n, []
        for period in range(1, last + 1):
            hit = bool(breach[list(at).index(period)]) if period in at else missing
            count = count + 1 if hit else 0
            want += [(period, count >= n)] if (count >= n) != state else []
            state = count >= n
        on, off, tail = stateful.alarm_runs(breach, at, last, missing, run, n)
        if run >= n:
            on, off = (on[1:], off) if len(on) and on[0] == 1 else (on, np.append(1, off))
        assert sorted([(int(p), True) for p in on] + [(int(p), False) for p in off if p <= last]) == want
        assert tail == count


def test_a_series_is_forgotten_after_its_silence(spark, tmp_path):
    rules = small_table(spark, [SPEC], fv.ALARM_COLUMNS)
    rows = [("d=1", T0, 5.0), ("d=2", T0, 5.0), *[("d=2", T0 + timedelta(minutes=m), 5.0) for m in range(1, 40)]]
    points = source(spark, tmp_path / "in", split(rows, 8), POINT).withColumn("alarm", F.lit("a"))
    periods = flows.metric_windows(points, ["alarm", "series"], 60, "min", "1 minute")
    out, last = drained(stateful.alarm_stream(periods, rules, retire_after=10), tmp_path)
    assert [(r.series, r.state) for r in out.collect()] == [("d=1", "ALARM")]
    states = [op for op in last["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert states[0]["numRowsTotal"] <= 4  # the value and timers of d=2


def drained(stream, tmp_path):
    """(rows, progress of the last batch) of a stream run to its end."""
    query = (
        stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
        .format("parquet").start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")), query.lastProgress


@pytest.mark.parametrize("error, most", [(0.0, 50), (0.05, 12)])
def test_percentile_state_is_bounded_by_values_not_rows(spark, tmp_path, error, most):
    random.seed(4)
    rows = [("s", T0 + timedelta(seconds=i % 50), float(random.randrange(50) + 50)) for i in range(4000)]
    stream = source(spark, tmp_path / "in", split(rows, 2), POINT)
    windows = flows.statistic_windows(stream, ["series"], 3600, ("min", "p50", "p90"), "1 minute", error)
    out, last = drained(windows, tmp_path)
    assert out.count() == 0 and sum(op["numRowsTotal"] for op in last["stateOperators"]) <= most
    late = [[*rows, ("s", T0 + timedelta(hours=3), 1.0)]]
    stream = source(spark, tmp_path / "again", late, POINT)
    got = flows.run_available(flows.statistic_windows(stream, ["series"], 3600, ("min", "p50", "p90"), "1 minute", error), "p").first()
    want = spark.createDataFrame(rows, POINT).selectExpr("min(value)", "percentile(value, 0.5)", "percentile(value, 0.9)").first()
    assert (got["min"], got.p50, got.p90) == pytest.approx(tuple(want), rel=error or 1e-12)


CLAIM = "resource_key string, machine_id string, observed_at timestamp, ttl_seconds int"


def test_live_claims_stream_equals_batch_at_each_time(spark, tmp_path):
    """Renewals, late rows, gaps, claims that never live, and an end without any later row of the claim."""
    random.seed(12)
    rows = []
    for i in range(300):
        ttl = random.choice([5, 40, 90, 0, None])
        rows.append((f"r{i % 4}", random.choice(["m1", "m2"]), T0 + timedelta(seconds=3 * i), ttl))
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=random.randrange(25)))
    mixed.append(("other", "m1", T0 + timedelta(hours=1), 1))
    stream = source(spark, tmp_path, split(mixed, 6), CLAIM)
    changes = flows.run_available(stateful.live_claims_stream(stream, "30 seconds", bucket_s=7), "claims").cache()
    table = spark.createDataFrame(rows, CLAIM)
    for second in (0, 1, 44, 45, 300, 601, 899, 950, 990, 1100):
        as_of = F.lit(T0 + timedelta(seconds=second))
        want = live_claims(table.where(F.col("observed_at") <= as_of), as_of).select("resource_key", "machine_id").distinct()
        assert sorted(map(tuple, stateful.live_at(changes, as_of).collect())) == sorted(map(tuple, want.collect()))
    ends = changes.where("resource_key <> 'other'").groupBy("resource_key", "machine_id").agg(F.max_by("change", "at").alias("last"))
    assert {r["last"] for r in ends.collect()} == {"expired"}


def test_probe_health_stream_equals_batch_also_out_of_order(spark, tmp_path):
    random.seed(10)
    rows = [(f"t{i % 3}", T0 + timedelta(seconds=i), i, random.random() < 0.5) for i in range(240)]
    mixed = sorted(rows, key=lambda r: r[2] + random.randrange(20))  # late by at most 20 s
    schema = "target string, ts timestamp, id long, ok boolean"
    stream = source(spark, tmp_path, split(mixed, 8), schema)
    got = flows.run_available(stateful.probe_health_stream(stream, "30 seconds", bucket_s=10), "health")
    want = health.target_health(spark.createDataFrame(rows, schema), ties=("id",))
    closed = F.col("ts") < F.lit(T0 + timedelta(seconds=200))  # buckets the watermark has passed
    expected = sorted(map(tuple, want.where(closed).select("id", "state").collect()))
    assert len(expected) == 200
    assert sorted(map(tuple, got.select("id", "state").collect())) == expected


def test_held_states_equal_a_loop():
    draw = random.Random(6)
    for _ in range(200):
        good, bad, state = (draw.randrange(3), 0, "healthy") if draw.random() < 0.5 else (0, draw.randrange(3), "initial")
        oks = [draw.random() < 0.6 for _ in range(draw.randrange(1, 30))]
        got = stateful.held_states(np.array(oks), good, bad, state, 2, 3)
        want = []
        for ok in oks:
            good, bad = (good + 1, 0) if ok else (0, bad + 1)
            state = "healthy" if good >= 2 else "unhealthy" if bad >= 3 else state
            want.append(state)
        assert (list(got[0]), got[1], got[2]) == (want, good, bad)


def test_hot_tail_over_batches(spark, tmp_path):
    """Late and repeated chunks, gaps, a chunk above the cap, closing and reopening."""
    chunks = [
        [("s", i, 40, False) for i in range(3)],
        [("s", 3, 40, False), ("t", 0, 10, False)],
        [("s", 0, 1, False), ("s", 3, 40, False), ("t", 1, 200, False), ("t", 2, 5, False)],
        [("u", 9, 30, False), ("u", 2, 30, False), ("u", 5, 30, False)],
        [("u", 11, 50, False), ("s", 4, 1, True)],
        [("s", 5, 7, False), ("u", 4, 1, False)],
    ]
    body = lambda name, seq, size: (name + str(seq % 10)).encode() * (size // 2) + b"." * (size % 2)
    rows = [[(n, q, z, body(n, q, z), c) for n, q, z, c in batch] for batch in chunks]
    stream = source(spark, tmp_path, rows, "session_id string, seq long, size long, body binary, closed boolean")
    out = flows.run_available(stateful.hot_tail(stream, 100), "tail")
    got = {(r.session_id, r.first_seq, r.last_seq, r.bytes_kept, bytes(r.tail)) for r in out.collect()}
    tail = lambda name, *parts: (name, parts[0][0], parts[-1][0], sum(z for _, z in parts), b"".join(body(name, *p) for p in parts))
    # the late repeat of seq 0 stays out, closing drops the tail, and a reopened session starts afresh
    assert got == {
        tail("s", (1, 40), (2, 40)), tail("s", (2, 40), (3, 40)), tail("t", (0, 10)), tail("t", (2, 5)), tail("s", (5, 7)),
        tail("u", (2, 30), (5, 30), (9, 30)), tail("u", (9, 30), (11, 50)),
    }


def test_dedup_across_batches_and_channels(spark, tmp_path):
    rows = [[(i, T0 + timedelta(seconds=i)) for i in part] for part in ([1, 2, 3], [2, 3, 4, 4], [1, 5])]
    stream = source(spark, tmp_path, rows, "event_id long, ts timestamp")
    out = flows.run_available(flows.dedup_dual_published(stream, "10 minutes"), "dedup")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5]


def test_log_metric_stream_keeps_zero_and_missing_apart(spark, tmp_path):
    lines = [("g", 10, "panicked at"), ("g", 70, "fine"), ("g", 200, "panicked at"), ("g", 900, "end")]
    rows = [[(g, T0 + timedelta(seconds=s), m)] for g, s, m in lines]
    stream = source(spark, tmp_path, rows, "log_group string, ts timestamp, message string")
    out = flows.run_available(metrics.log_metric(stream, ["panicked at"], 60, watermark="1 minute"), "log")
    got = sorted((r.period_start, r.value) for r in out.collect())
    assert got == [(T0, 1.0), (T0 + timedelta(seconds=60), 0.0), (T0 + timedelta(seconds=180), 1.0)]


@pytest.mark.parametrize("rate, share", [(0.0, 0.0), (0.25, 0.25), (1.0, 1.0)])
def test_sampling(spark, rate, share):
    spans = spark.range(4000).selectExpr(
        "md5(CAST(id DIV 2 AS STRING)) AS trace_id", "id", "CASE WHEN id < 10 THEN 'auth-failure' END AS tag"
    )
    kept = flows.sample_spans(spans, rate)
    assert kept.where("tag IS NOT NULL").count() == 10
    untagged = kept.where("id >= 10")
    assert untagged.count() / 3990 == pytest.approx(share, abs=0.03)
    assert untagged.groupBy("trace_id").count().where("count <> 2").count() == 0


def test_waiting_rows_are_no_entries_of_the_python_state(spark, tmp_path):
    """A backlog over many buckets costs a key no state calls; each bucket was an entry before."""
    times = [T0 + timedelta(minutes=m) for m in range(300)]
    probes = source(spark, tmp_path / "in", [[("t", ts, i, True) for i, ts in enumerate(times)]], "target string, ts timestamp, id long, ok boolean")
    claims = source(spark, tmp_path / "also", [[("r", "m", ts, 5) for ts in times]], CLAIM)
    for name, stream in (
        ("health", stateful.probe_health_stream(probes, "20 hours")), ("claims", stateful.live_claims_stream(claims, "20 hours"))
    ):
        (tmp_path / name).mkdir()
        out, last = drained(stream, tmp_path / name)
        states = {op["operatorName"]: op["numRowsTotal"] for op in last["stateOperators"]}
        assert out.count() == 0 and states.pop("transformWithStateInPandasExec") == 0 and sum(states.values()) == 300


def test_repeated_probes_each_count(spark, tmp_path):
    schema = "target string, ts timestamp, id long, ok boolean"
    rows = [("t", T0, 1, True), ("t", T0, 1, True), ("t", T0 + timedelta(seconds=5), 2, False), ("u", T0 + timedelta(hours=1), 9, True)]
    stream = source(spark, tmp_path, split(rows, 2), schema)
    got = flows.run_available(stateful.probe_health_stream(stream, "1 second"), "health")
    assert sorted((r.id, r.state) for r in got.collect()) == [(1, "healthy"), (1, "initial"), (2, "healthy")]
