"""Windows, alarms, health, recovery and budget."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions.text_rules import term_match
from fleetscope.operators import budget, health, metrics
from fleetscope.operators.ordered_scan import OrderedScan, exact_percentile
from fleetscope.session import small_table
from fleetscope.sources import readers, writers

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def specs(spark, *alarms):
    return small_table(spark, list(alarms), fv.ALARM_COLUMNS)


def alarm(name="a", stat="sum", period=300, n=1, op=">=", threshold=5.0, missing="notBreaching", notify=True, dims=("d",)):
    return (name, "ns", "m", list(dims), stat, period, n, op, threshold, missing, notify)


def evaluate(spark, spec, points, **span):
    rules = specs(spark, spec)
    data = [("ns", "m", {"d": "1"}, at(second), float(v)) for second, v in points]
    table = spark.createDataFrame(data, readers.METRIC_SCHEMA)
    periods = metrics.metric_stat(metrics.alarm_series(table, rules), rules)
    filled = metrics.fill_missing(periods, rules, **span)
    return metrics.evaluate_alarm(filled, rules)


def states(df):
    return [r.state for r in df.orderBy("period_start").collect()]


def test_term_match(spark):
    zero = fv.LOG_METRIC_TERMS["plan_ingest_scanned_zero"]
    lines = ["plan_ingest_worker: cycle (scanned=0 transitions=0)", "plan_ingest_worker: cycle (scanned=30 x)", "(scanned=0 ", None]
    table = spark.createDataFrame([(x,) for x in lines], "m string").select(term_match(F.col("m"), zero))
    assert [r[0] for r in table.collect()] == [True, False, False, False]


def test_zero_is_not_missing(spark, rows):
    lines = [("g", at(10), "panicked at x"), ("g", at(20), "panicked at y"), ("g", at(310), "fine"), ("g", at(950), "panicked at")]
    out = metrics.log_metric(spark.createDataFrame(lines, readers.LOG_SCHEMA), ["panicked at"], 300)
    assert sorted(rows(out, "period_start", "value")) == [(at(0), 2.0), (at(300), 0.0), (at(900), 1.0)]


@pytest.mark.parametrize("op, want", [(">=", ["ALARM"]), (">", ["OK"]), ("<", ["OK"])])
def test_threshold_is_exact(spark, op, want):
    assert states(evaluate(spark, alarm(op=op), [(0, 2), (1, 3)])) == want


def test_two_of_two_and_transitions(spark, rows):
    out = evaluate(spark, alarm(n=2), [(0, 9), (300, 1), (600, 9), (900, 9), (1200, 9), (1500, 0)])
    assert states(out) == ["OK", "OK", "OK", "ALARM", "ALARM", "OK"]
    changed = metrics.alarm_transitions(out)
    assert rows(changed, "period_start", "state") == [(at(900), "ALARM"), (at(1500), "OK")]
    assert metrics.alarm_actions(changed).count() == 2


def test_recovery_is_silent_where_not_declared(spark, tmp_path):
    changed = metrics.alarm_transitions(evaluate(spark, alarm(notify=False), [(0, 9), (300, 0)]))
    assert changed.count() == 2
    writers.write_alarm_actions(changed, str(tmp_path / "actions"))
    assert [r.state for r in spark.read.parquet(str(tmp_path / "actions")).collect()] == ["ALARM"]


@pytest.mark.parametrize("missing, want", [("breaching", ["OK", "OK", "OK", "ALARM", "OK"]), ("notBreaching", ["OK"] * 5)])
def test_gaps_follow_the_policy(spark, missing, want):
    spec = alarm(stat="min", period=60, n=3, op="<", threshold=1.0, missing=missing)
    assert states(evaluate(spark, spec, [(0, 5), (240, 5)])) == want


def test_span_is_explicit_where_given(spark):
    spec = alarm(stat="min", period=60, n=3, op="<", threshold=1.0, missing="breaching")
    span = {"since": F.lit(at(-60)), "until": F.lit(at(240))}
    assert states(evaluate(spark, spec, [(0, 5)], **span)) == ["OK", "OK", "OK", "OK", "ALARM"]


def test_a_series_that_never_published_alarms_when_expected(spark, rows):
    spec = alarm(stat="min", period=60, n=3, op="<", threshold=1.0, missing="breaching")
    expected = spark.createDataFrame([("a", "d=2")], "alarm string, series string")
    out = evaluate(spark, spec, [(0, 5)], since=F.lit(at(0)), until=F.lit(at(180)), expected=expected)
    assert rows(out.where("series = 'd=2' AND state = 'ALARM'"), "period_start") == [(at(120),)]


def test_statistics_and_dimension_match(spark, rows):
    names = ["min", "sum", "avg", "p90"]
    rules = specs(spark, *[alarm(name, stat=name) for name in names], alarm("none", dims=()))
    data = [("ns", "m", {"d": "1"}, at(i), float(i)) for i in range(1, 11)]
    data += [("ns", "m", {"d": "1", "e": "2"}, at(0), 99.0), ("ns", "other", {"d": "1"}, at(0), 99.0), ("ns", "m", None, at(0), 7.0)]
    table = spark.createDataFrame(data, readers.METRIC_SCHEMA)
    exact = metrics.metric_stat(metrics.alarm_series(table, rules), rules)
    assert dict(rows(exact, "alarm", "value")) == {"min": 1.0, "sum": 55.0, "avg": 5.5, "p90": pytest.approx(9.1), "none": 7.0}
    subset = metrics.metric_stat(metrics.alarm_series(table, rules, match="subset"), rules)
    assert dict(rows(subset.where("alarm = 'sum'"), "alarm", "value")) == {"sum": 154.0}


def test_declared_alarms_over_log_metrics(spark):
    rules = metrics.declared_alarms(spark)
    assert rules.count() == 10
    lines = [("g", at(i), "panicked at") for i in range(10)] + [("g", at(600), "ok")]
    counted = metrics.log_metric(spark.createDataFrame(lines, readers.LOG_SCHEMA), ["panicked at"], 300)
    points = counted.select(
        F.lit("App").alias("namespace"), F.lit("worker_panic").alias("metric"),
        F.create_map().cast("map<string,string>").alias("dims"), F.col("period_start").alias("ts"), "value",
    )
    periods = metrics.metric_stat(metrics.alarm_series(points, rules), rules)
    out = metrics.evaluate_alarm(metrics.fill_missing(periods, rules), rules)
    assert states(out.where("alarm = 'worker-panic'")) == ["ALARM", "OK", "OK"]


def brute_health(flags, up=2, down=3):
    state, good, bad, out = "initial", 0, 0, []
    for ok in flags:
        good, bad = (good + 1, 0) if ok else (0, bad + 1)
        state = "healthy" if good >= up else "unhealthy" if bad >= down else state
        out.append(state)
    return out


@pytest.mark.parametrize("max_rows", [10_000, 9])
def test_health_against_brute_force(spark, max_rows):
    random.seed(4)
    flags = [random.random() < 0.5 for _ in range(200)]
    data = [("t", at(i // 2), i, ok) for i, ok in enumerate(flags)] + [("u", at(0), 0, True)]
    probes = spark.createDataFrame(data, "target string, ts timestamp, id int, ok boolean")
    out = health.target_health(probes, ties=("id",), max_rows=max_rows)
    assert [r.state for r in out.where("target = 't'").orderBy("id").collect()] == brute_health(flags)
    assert out.where("target = 'u'").first().state == "initial"


def test_recovery_bounds(spark):
    kills = spark.createDataFrame([("s", at(k)) for k in (0, 100, 200, 300, 400)] + [("q", at(0))], "svc string, ts timestamp")
    oks = [("s", at(0), True), ("s", at(130), True), ("s", at(231), True), ("s", at(310), False), ("s", at(405), True), ("s", at(406), True)]
    probes = spark.createDataFrame(oks, "svc string, ts timestamp, ok boolean")
    got = {(r.svc, r.killed_at): (r.elapsed_s, r.passed) for r in health.recovery_time(kills, probes).collect()}
    assert got == {
        ("s", at(0)): (0.0, True), ("s", at(100)): (30.0, True), ("s", at(200)): (None, False),
        ("s", at(300)): (None, False), ("s", at(400)): (5.0, True), ("q", at(0)): (None, False),
    }


def test_budget(spark):
    costs = [(datetime(2024, 2, 1), "40"), (datetime(2024, 2, 10), "40"), (datetime(2024, 3, 31), "80.01"), (datetime(2024, 4, 30), "100")]
    table = spark.createDataFrame(costs, "ts timestamp, amount string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.month.month: (r.actual_alert, r.forecast_alert, round(r.forecast, 2)) for r in budget.budget_alerts(table).collect()}
    assert got == {2: (False, True, 232.0), 3: (True, False, 80.01), 4: (True, False, 100.0)}


@pytest.mark.parametrize("max_rows, descending", [(10**6, False), (150, False), (11, True)])
def test_ordered_scan_against_brute_force(spark, max_rows, descending):
    """A bursty key with most rows, quiet keys and a NULL key, in all block sizes."""
    random.seed(5)
    data = []
    for i in range(1500):
        key = random.choice(["hot"] * 6 + ["a", None])
        data.append((key, int(random.lognormvariate(3, 2.5)) if key == "hot" else i, i, random.randrange(100)))
    df = spark.createDataFrame(data, "k string, o long, id long, v long")
    odd = F.when(F.col("v") % 7 == 0, F.col("id"))
    scan = OrderedScan(df, ["k"], "o", ("id",), descending=descending, max_rows=max_rows)
    out = scan.running_sum(F.col("v"), "run").total(F.col("v"), "all").carry_last(last=odd).frame
    want = []
    for key in {row[0] for row in data}:
        run, last = 0, None
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]), reverse=descending)
        for row in mine:
            run += row[3]
            last = row[2] if row[3] % 7 == 0 else last
            want.append((*row, run, sum(r[3] for r in mine), last))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_scan_splits_one_time_of_one_key(spark, descending):
    """Most rows share key and time, many of them all ties too; no block is large, and sums are as in one window."""
    random.seed(6)
    data = [("hot", 5, random.choice("abc"), 1) for _ in range(1200)] + [("hot", t, "x", 1) for t in range(9)] + [("b", 5, "y", 1)]
    scan = OrderedScan(spark.createDataFrame(data, "k string, o long, tie string, v long"), ["k"], "o", ("tie",), descending=descending, max_rows=100)
    blocks = scan._df.groupBy(*scan._keys, *scan._blocks).count()
    assert blocks.agg(F.max("count")).first()[0] <= 150
    out = scan.running_sum(F.col("v"), "run").total(F.col("v"), "all").carry_last(last=F.col("tie")).frame
    got = sorted((r.run, r.o, r.tie, r["all"], r["last"]) for r in out.where("k = 'hot'").collect())
    order = sorted((row[1:3] for row in data if row[0] == "hot"), reverse=descending)
    assert got == [(i + 1, o, tie, 1209, tie) for i, (o, tie) in enumerate(order)]


@pytest.mark.parametrize("max_rows, descending", [(5, False), (5, True)])
def test_ordered_scan_with_null_nan_and_infinite_order(spark, max_rows, descending):
    odd = [None, float("-inf"), -1e12, 0.5, 3.0, 1e9, float("inf"), float("nan")]
    data = [(value, i) for i, value in enumerate(odd * 4)]
    df = spark.createDataFrame(data, "o double, id long").withColumn("k", F.lit("hot"))
    out = OrderedScan(df, ["k"], "o", ("id",), descending=descending, max_rows=max_rows)
    got = {r.id: r.run for r in out.running_sum(F.lit(1), "run").frame.collect()}
    rank = sorted(range(len(data)), key=lambda i: (odd.index(odd[i % 8]), i), reverse=descending)
    assert got == {i: position + 1 for position, i in enumerate(rank)}


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_percentile_equals_the_builtin(spark, max_rows):
    random.seed(6)
    data = [(random.choice("aaab"), round(random.lognormvariate(0, 3), 2)) for _ in range(1000)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    want = {r.k: r.p for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.lit(0.9)).alias("p")).collect()}
    got = {r.k: r.p for r in exact_percentile(df, ["k"], "v", 0.9, "p", max_rows=max_rows).collect()}
    assert got == pytest.approx(want)


def test_log_and_metric_files(spark, rows, tmp_path):
    (tmp_path / "app.log").write_text("2024-01-01T00:00:00Z started well\nno time here\n2024-01-01T00:00:05Z\n")
    lines = readers.scan_logs(spark, str(tmp_path / "app.log"), "app")
    assert rows(lines, "ts", "message") == sorted(
        [(at(0), "started well"), (None, "no time here"), (at(5), "")], key=str
    )
    point = [("ns", "m", {"d": "1"}, at(0), 1.0)]
    spark.createDataFrame(point, readers.METRIC_SCHEMA).write.parquet(str(tmp_path / "metrics"))
    assert rows(readers.scan_metrics(spark, str(tmp_path / "metrics")), "metric", "value") == [("m", 1.0)]
