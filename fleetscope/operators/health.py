"""Target health from probes and recovery time after a kill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators.ordered_scan import MAX_ROWS, OrderedScan


def target_health(
    probes: DataFrame,
    ties: tuple[str, ...] = (),
    up: int = fv.HEALTHY_AFTER,
    down: int = fv.UNHEALTHY_AFTER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """State after each probe: ``up`` straight successes or ``down`` straight failures switch it.

    ``probes``: target, ts, ok. In between the last state holds; before the
    first switch it is ``initial``.
    """
    ok, rn = F.col("ok"), F.col("_rn")
    scan = (
        OrderedScan(probes, ["target"], "ts", ties, max_rows=max_rows)
        .running_sum(F.lit(1), "_rn")
        .carry_last(_last_bad=F.when(~ok, rn), _last_good=F.when(ok, rn))
    )
    switch = F.when(ok & (rn - F.coalesce("_last_bad", F.lit(0)) >= up), F.lit("healthy")).when(
        ~ok & (rn - F.coalesce("_last_good", F.lit(0)) >= down), F.lit("unhealthy")
    )
    held = scan.carry_last(_state=switch).frame
    return held.withColumn("state", F.coalesce("_state", F.lit("initial"))).drop(
        "_rn", "_last_bad", "_last_good", "_state"
    )


def recovery_time(kills: DataFrame, probes: DataFrame, ttl_s: int = fv.RECOVERY_TTL_S) -> DataFrame:
    """First healthy probe at or after each kill, within ``ttl_s`` seconds.

    ``kills``: svc, ts; ``probes``: svc, ts, ok. The target is bounded, so an
    answer lies in the kill's own time slice of ``ttl_s`` or in the next one:
    work is split by (svc, slice), a busy service over as many tasks as it has
    slices, and no pairs are formed. A kill without an answer stays, failed.
    """
    width = ttl_s * 1_000_000
    slice_of = lambda ts: F.floor(F.unix_micros(ts) / width).cast("bigint")
    healthy = probes.where("ok").select("svc", "ts", slice_of("ts").alias("_slice"), F.col("ts").alias("_seen"))
    marks = kills.select("svc", "ts", slice_of("ts").alias("_slice"), F.lit(None).cast("timestamp").alias("_seen"))
    backwards = Window.partitionBy("svc", "_slice").orderBy(F.desc("ts"), F.desc_nulls_last("_seen"))
    same = (
        marks.union(healthy)
        .withColumn(
            "_same", F.last("_seen", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
        )
        .where(F.col("_seen").isNull())
    )
    following = healthy.groupBy("svc", (F.col("_slice") - 1).alias("_slice")).agg(F.min("_seen").alias("_next"))
    answer = F.coalesce("_same", "_next")
    elapsed = (F.unix_micros(answer) - F.unix_micros("ts")) / 1_000_000
    passed = F.coalesce(elapsed <= ttl_s, F.lit(False))
    return same.join(following, ["svc", "_slice"], "left").select(
        "svc",
        F.col("ts").alias("killed_at"),
        F.when(passed, answer).alias("recovered_at"),
        F.when(passed, elapsed).alias("elapsed_s"),
        passed.alias("passed"),
    )
