"""Queries of metric, log, health, recovery and budget monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import budget, health, metrics
from fleetscope.plans.registry import EVENT_SCHEMA, Tables, query, to_duckdb
from fleetscope.session import small_table
from fleetscope.streaming import flows, stateful

PERIOD_S = 21_600

#: Alarms over the events table; six-hour periods because events are minutes apart.
EVENT_ALARMS = (
    ("error-sum", "events", "error", ["shard"], "sum", PERIOD_S, 2, ">=", 150.0, "notBreaching", True),
    ("view-min", "events", "view", ["shard"], "min", PERIOD_S, 3, "<", 20.0, "breaching", True),
    ("click-avg", "events", "click", ["shard"], "avg", PERIOD_S, 1, ">", 80.0, "notBreaching", False),
    ("purchase-p90", "events", "purchase", ["shard"], "p90", PERIOD_S, 1, ">", 150.0, "notBreaching", False),
)

_SPECS_SQL = "specs(alarm, metric, stat, n, op, threshold, missing, notify_ok) AS (VALUES " + ", ".join(
    f"('{a}', '{m}', '{stat}', {n}, '{op}', {limit}, '{missing}', {notify})"
    for a, _, m, _, stat, _, n, op, limit, missing, notify in EVENT_ALARMS
) + ")"

_START = f"make_timestamp(CAST(floor(epoch_us(ts) / {PERIOD_S}000000) * {PERIOD_S}000000 AS BIGINT))"

_STAT_SQL = f"""
{_SPECS_SQL},
stats AS (
  SELECT alarm, 'shard=' || CAST(user_id % 8 AS VARCHAR) AS series, {_START} AS period_start, stat,
    CASE stat WHEN 'min' THEN min(value) WHEN 'sum' THEN sum(value) WHEN 'avg' THEN avg(value)
      ELSE quantile_cont(value, 0.9) END AS value
  FROM events JOIN specs ON event_type = metric GROUP BY 1, 2, 3, 4)
"""

_EVAL_SQL = f"""
{_STAT_SQL},
spans AS (
  SELECT DISTINCT alarm, series, min(period_start) OVER (PARTITION BY alarm, series) AS lo,
    max(period_start) OVER (PARTITION BY alarm) AS hi FROM stats),
grid AS (
  SELECT alarm, series, unnest(generate_series(lo, hi, INTERVAL {PERIOD_S} SECOND)) AS period_start FROM spans),
judged AS (
  SELECT alarm, series, period_start, s.value, notify_ok, n,
    CASE WHEN s.value IS NULL THEN missing = 'breaching' WHEN op = '<' THEN s.value < threshold
      WHEN op = '>' THEN s.value > threshold ELSE s.value >= threshold END AS breach
  FROM grid LEFT JOIN stats s USING (alarm, series, period_start) JOIN specs USING (alarm)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY alarm, series ORDER BY period_start) AS rn FROM judged),
stated AS (
  SELECT *, CASE WHEN rn - max(CASE WHEN breach THEN 0 ELSE rn END) OVER (
      PARTITION BY alarm, series ORDER BY period_start) >= n THEN 'ALARM' ELSE 'OK' END AS state FROM numbered),
evaluated AS (
  SELECT *, lag(state, 1, 'OK') OVER (PARTITION BY alarm, series ORDER BY period_start) AS previous FROM stated)
"""


def _specs(t: Tables) -> DataFrame:
    return small_table(t.spark, list(EVENT_ALARMS), fv.ALARM_COLUMNS)


def _points(t: Tables) -> DataFrame:
    return t("events").select(
        F.lit("events").alias("namespace"),
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("shard"), (F.col("user_id") % 8).cast("string")).alias("dims"),
        "ts",
        "value",
    )


def _evaluated(t: Tables) -> DataFrame:
    specs = _specs(t)
    periods = metrics.metric_stat(metrics.alarm_series(_points(t), specs), specs)
    return metrics.evaluate_alarm(metrics.fill_missing(periods, specs), specs)


@query(
    "metric_stat",
    f"WITH {_STAT_SQL} SELECT alarm, series, period_start, round(value, 6) AS value FROM stats",
)
def metric_stat(t: Tables) -> DataFrame:
    specs = _specs(t)
    periods = metrics.metric_stat(metrics.alarm_series(_points(t), specs), specs)
    return periods.withColumn("value", F.round("value", 6))


@query(
    "alarm_states",
    f"WITH {_EVAL_SQL} SELECT alarm, series, period_start, round(value, 6) AS value, breach, state FROM evaluated",
)
def alarm_states(t: Tables) -> DataFrame:
    out = _evaluated(t).withColumn("value", F.round("value", 6))
    return out.select("alarm", "series", "period_start", "value", "breach", "state")


@query(
    "alarm_transitions",
    f"WITH {_EVAL_SQL} SELECT alarm, series, period_start, state, previous FROM evaluated WHERE state <> previous",
)
def alarm_transitions(t: Tables) -> DataFrame:
    return metrics.alarm_transitions(_evaluated(t)).select("alarm", "series", "period_start", "state", "previous")


@query(
    "alarm_actions",
    f"""WITH {_EVAL_SQL} SELECT alarm, series, period_start, state, round(value, 6) AS value FROM evaluated
    WHERE state <> previous AND (state = 'ALARM' OR notify_ok)""",
)
def alarm_actions(t: Tables) -> DataFrame:
    out = metrics.alarm_actions(metrics.alarm_transitions(_evaluated(t)))
    return out.withColumn("value", F.round("value", 6))


#: Log lines told from events, in the wording the declared log metrics look for.
LOG_LINES = """
SELECT 'group-' || CAST(user_id % 4 AS STRING) AS log_group, ts, CASE event_type
  WHEN 'view' THEN 'plan_ingest_worker: cycle (scanned=' || CAST(user_id % 3 AS STRING) || ' transitions=0)'
  WHEN 'error' THEN 'thread worker panicked at step ' || props
  WHEN 'signup' THEN 'pr_merge hydration has been ' || CASE WHEN user_id % 2 = 0 THEN 'DISABLED' ELSE 'disabled' END
  ELSE 'request ' || props END AS message
FROM {events}
"""

_LOG_SQL = " UNION ALL ".join(
    f"""SELECT '{metric}' AS metric, log_group, {_START.replace(f"{PERIOD_S}000000", "3600000000")} AS period_start,
    CAST(sum(CASE WHEN {" AND ".join(f"contains(message, '{term}')" for term in terms)} THEN 1 ELSE 0 END) AS DOUBLE)
      AS value FROM lines GROUP BY ALL"""
    for metric, terms in fv.LOG_METRIC_TERMS.items()
)


@query("log_metric_terms", f"WITH lines AS ({to_duckdb(LOG_LINES)}) {_LOG_SQL}")
def log_metric_terms(t: Tables) -> DataFrame:
    return metrics.log_metrics(t.sql(LOG_LINES), fv.LOG_METRIC_TERMS, 3600).drop("period_end")


_PROBE_SQL = """
WITH runs AS (
  SELECT event_id, user_id, event_type IN ('view', 'click') AS ok, ts FROM events),
looked AS (
  SELECT *, lag(ok, 1) OVER w AS ok1, lag(ok, 2) OVER w AS ok2 FROM runs
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
crossed AS (
  SELECT *, CASE WHEN ok AND ok1 THEN 'healthy' WHEN NOT ok AND NOT ok1 AND NOT ok2 THEN 'unhealthy' END AS c
  FROM looked)
SELECT event_id, user_id AS target, ok, coalesce(last_value(c IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'initial') AS state FROM crossed
"""


def _probes(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").alias("target"), F.col("event_type").isin("view", "click").alias("ok"), "ts"
    )


@query("target_health", _PROBE_SQL)
def target_health(t: Tables) -> DataFrame:
    return health.target_health(_probes(t("events")), ties=("event_id",)).select("event_id", "target", "ok", "state")


@query(
    "recovery_time",
    """
    WITH kills AS (SELECT user_id AS svc, ts AS killed_at FROM events WHERE event_type = 'error'),
    hits AS (
      SELECT svc, killed_at, min(e.ts) AS recovered_at FROM kills LEFT JOIN events e
      ON e.user_id = svc AND e.event_type = 'view' AND e.ts >= killed_at
        AND epoch_us(e.ts) - epoch_us(killed_at) <= 3600000000 GROUP BY ALL)
    SELECT svc, killed_at, recovered_at, (epoch_us(recovered_at) - epoch_us(killed_at)) / 1000000.0::DOUBLE AS elapsed_s,
      recovered_at IS NOT NULL AS passed FROM hits
    """,
)
def recovery_time(t: Tables) -> DataFrame:
    seen = t("events").select(F.col("user_id").alias("svc"), "ts", "event_type")
    kills = seen.where("event_type = 'error'").select("svc", "ts")
    probes = seen.where("event_type = 'view'").select("svc", "ts", F.lit(True).alias("ok"))
    return health.recovery_time(kills, probes, ttl_s=3600)


@query(
    "budget_alerts",
    """
    WITH monthly AS (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS actual, day(max(o_orderdate)) AS days
      FROM orders GROUP BY ALL)
    SELECT month, actual, round(actual / days * day(last_day(month)), 4) AS forecast,
      actual > 47000000 * 0.8 AS actual_alert, actual / days * day(last_day(month)) > 47000000 AS forecast_alert
    FROM monthly
    """,
)
def budget_alerts(t: Tables) -> DataFrame:
    costs = t("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"))
    return budget.budget_alerts(costs, "47000000").withColumn("forecast", F.round("forecast", 4))


#: Where the heartbeat has moved the watermark.
_PASSED = "(SELECT max(ts) + INTERVAL 2 HOUR FROM events)"


@query(
    "stream_log_metric",
    f"""WITH lines AS ({to_duckdb(LOG_LINES)}), counted AS ({_LOG_SQL})
    SELECT log_group, period_start, value FROM counted WHERE metric = 'worker_panic'""",
)
def stream_log_metric(t: Tables) -> DataFrame:
    lines = t.spark.sql(LOG_LINES, events=t.stream_to_the_end("events", EVENT_SCHEMA))
    counted = metrics.log_metric(lines, fv.LOG_METRIC_TERMS["worker_panic"], 3600, watermark="1 hour")
    return flows.run_available(counted.drop("period_end"), "log-metric")


_STREAM_STATS = ("min", "sum", "avg", "p90")

_WINDOWS_SQL = " UNION ALL ".join(
    f"""SELECT event_type, {period}::INTEGER AS period_s, period_start,
      min(value) AS "min", sum(value) AS "sum", avg(value) AS "avg", quantile_cont(value, 0.9) AS p90
    FROM (SELECT *, make_timestamp(CAST(floor(epoch_us(ts) / {period}000000) * {period}000000 AS BIGINT)) AS period_start
      FROM events) WHERE period_start + INTERVAL {period} SECOND <= {_PASSED} GROUP BY event_type, period_start"""
    for period in fv.PERIODS_S
)


@query(
    "stream_metric_windows",
    "SELECT event_type, period_s, period_start, "
    + ", ".join(f'round("{stat}", 6) AS "{stat}"' for stat in _STREAM_STATS)
    + f" FROM ({_WINDOWS_SQL})",
)
def stream_metric_windows(t: Tables) -> DataFrame:
    """All statistics at all declared periods, in one stream."""
    windows = [
        flows.statistic_windows(
            t.stream_to_the_end("events", EVENT_SCHEMA).where("event_type IS NOT NULL OR event_id IS NULL"),
            ["event_type"], period, _STREAM_STATS, "1 hour",
        ).withColumn("period_s", F.lit(period))
        for period in fv.PERIODS_S
    ]
    whole = reduce(DataFrame.unionByName, windows).drop("period_end")
    out = flows.run_available(whole, "metric-windows").where("event_type IS NOT NULL")
    return out.withColumns({stat: F.round(stat, 6) for stat in _STREAM_STATS})


#: Shards that never publish, and from when on they are expected; their alarms treat silence each in its own way.
_SILENT = ("shard=8", "shard=9")
_SINCE = "2024-01-01 00:00:00"

_STREAM_EVAL_SQL = _EVAL_SQL.replace(
    "max(period_start) OVER (PARTITION BY alarm)",
    f"""make_timestamp(CAST((floor(epoch_us({_PASSED}) / {PERIOD_S}000000) - 1) * {PERIOD_S}000000 AS BIGINT))""",
).replace(
    "FROM stats),\ngrid",
    f"""FROM stats UNION ALL SELECT alarm, unnest({list(_SILENT)}), TIMESTAMP '{_SINCE}',
      make_timestamp(CAST((floor(epoch_us({_PASSED}) / {PERIOD_S}000000) - 1) * {PERIOD_S}000000 AS BIGINT)) FROM specs),
grid""",
)


@query(
    "stream_alarm_transitions",
    f"""WITH {_STREAM_EVAL_SQL} SELECT alarm, series, period_start, round(value, 6) AS value, state, previous
    FROM evaluated WHERE state <> previous""",
)
def stream_alarm_transitions(t: Tables) -> DataFrame:
    """All declared alarms in one stream, with series that never publish."""
    specs = _specs(t)
    points = t.stream_to_the_end("events", EVENT_SCHEMA)
    kind = F.coalesce("event_type", F.lit("heartbeat")).alias("event_type")  # the join would drop a null below the watermark
    keyed = points.select("ts", "value", kind, F.concat(F.lit("shard="), F.col("user_id") % 8).alias("series"))
    stats = flows.statistic_windows(keyed, ["event_type", "series"], PERIOD_S, _STREAM_STATS, "1 hour")
    chosen = F.when(F.lit(False), F.lit(0.0))
    for stat in _STREAM_STATS:
        chosen = chosen.when(F.col("stat") == stat, F.col(stat))
    watched = specs.select("alarm", F.col("metric").alias("event_type"), "stat")
    periods = stats.join(F.broadcast(watched), "event_type").withColumn("value", chosen)
    periods = periods.select("alarm", "series", "period_start", "period_end", "value")
    silent = specs.select("alarm", F.explode(F.array(*map(F.lit, _SILENT))).alias("series"))
    changes = stateful.alarm_stream(periods, specs, expected=silent, since=F.lit(_SINCE).cast("timestamp"))
    out = flows.run_available(changes, "alarm-stream").withColumn("value", F.round("value", 6))
    return out.select("alarm", "series", "period_start", "value", "state", "previous")


@query(
    "stream_probe_health",
    f"SELECT event_id, target, ok, state FROM ({_PROBE_SQL}) JOIN events USING (event_id) WHERE ts < {_PASSED}",
)
def stream_probe_health(t: Tables) -> DataFrame:
    probes = _probes(t.stream_to_the_end("events", EVENT_SCHEMA))
    keyed = probes.select(
        F.coalesce(F.col("target").cast("string"), F.lit("heartbeat")).alias("target"),
        "ts",
        F.coalesce("event_id", F.lit(-1)).alias("id"),
        F.coalesce("ok", F.lit(True)).alias("ok"),
    )
    out = flows.run_available(stateful.probe_health_stream(keyed, "1 hour", bucket_s=3600), "probe-health")
    return out.select(F.col("id").alias("event_id"), F.col("target").cast("bigint").alias("target"), "ok", "state")


@query("stream_dedup", "SELECT event_id, event_type, user_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    channels = [t.stream("events", EVENT_SCHEMA).select("event_id", "ts", "event_type", "user_id") for _ in range(2)]
    once = flows.dedup_dual_published(channels[0].union(channels[1]), "1 hour")
    return flows.run_available(once.drop("ts"), "dedup")


SPANS = """
SELECT md5(CAST(user_id * 31 + event_id AS STRING)) AS trace_id, event_id, CASE
  WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'auth-failure'
  WHEN event_type = 'click' AND user_id % 7 = 0 THEN 'merge-conflict'
  WHEN event_type = 'view' THEN 'page' END AS tag
FROM {events}
"""


@query(
    "span_sample",
    f"""SELECT event_id, trace_id, tag FROM ({to_duckdb(SPANS)}) WHERE tag IN ('auth-failure', 'merge-conflict')
    OR CAST('0x' || right(trace_id, 8) AS BIGINT) < {int(0.01 * 2**32)}""",
)
def span_sample(t: Tables) -> DataFrame:
    return flows.sample_spans(t.sql(SPANS)).select("event_id", "trace_id", "tag")
