"""Streaming forms of the built-in kind: windows, deduplication, sampling, expiry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators.metrics import statistic
from fleetscope.session import scratch_path


def metric_windows(points: DataFrame, by: list[str], period_s: int, stat: str, watermark: str) -> DataFrame:
    """One statistic per group and tumbling period, emitted once the watermark passes it.

    A percentile comes from the counted values of ``statistic_windows``.
    """
    if stat not in ("min", "sum", "avg"):
        return statistic_windows(points, by, period_s, (stat,), watermark).withColumnRenamed(stat, "value")
    return (
        points.withWatermark("ts", watermark)
        .groupBy(*by, F.window("ts", f"{period_s} seconds").alias("w"))
        .agg(statistic(stat, F.col("value")).alias("value"))
        .select(*by, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "value")
    )


def rounded(value: Column, error: float) -> Column:
    """``value`` moved to the next of a fixed scale, at most the share ``error`` of it away.

    Between 1e-9 and 1e9 the scale has about 41 / (2 * error) steps for each sign; smaller ones become 0.
    """
    step = math.log1p(2 * error)
    size = F.exp(F.round(F.ln(F.abs(value)) / step) * step)
    return F.when(F.abs(value) < 1e-9, F.lit(0.0)).otherwise(F.signum(value) * size)


def statistic_windows(
    points: DataFrame, by: list[str], period_s: int, stats: Sequence[str], watermark: str, error: float = 0.0
) -> DataFrame:
    """Several statistics per group and tumbling period, a column each, percentiles (``p90``) among them.

    Two steps: rows are counted by (group, period, value), and when the watermark passes a period, its
    counts give the statistics. So the state has a row for each different value of an open period,
    whatever the number of points, and counts merge on the map side. With an ``error`` values are
    rounded first: the state is then bounded by the scale, and each statistic is off by that share
    at most, sums of mixed signs excepted. Without it everything is exact.
    """
    value = rounded(F.col("value"), error) if error else F.col("value").cast("double")
    counted = (
        points.withWatermark("ts", watermark)
        .groupBy(*by, F.window("ts", f"{period_s} seconds").alias("w"), value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total, n = F.sum(F.col("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    known = {"min": F.min("value"), "sum": total, "avg": total / n}
    known |= {f"p{q}": F.percentile("value", F.lit(q / 100), F.col("n")) for q in range(1, 100)}
    out = counted.groupBy(*by, "w").agg(*[known[stat].alias(stat) for stat in stats])
    return out.select(*by, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *stats)


def dedup_dual_published(events: DataFrame, watermark: str) -> DataFrame:
    """Each event_id once, however often and over whichever channel it was published.

    Copies may be apart by as much as the watermark; state older than that goes.
    """
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def sample_spans(spans: DataFrame, rate: float = fv.SAMPLE_RATE, tags=fv.ALWAYS_SAMPLED_TAGS) -> DataFrame:
    """All tagged spans, and a fixed share of traces; a trace is kept or dropped as a whole.

    Trace ids are random hex text, so their last eight digits are the dice.
    """
    share = F.conv(F.right("trace_id", F.lit(8)), 16, 10).cast("bigint") < int(rate * 2**32)
    return spans.where(F.coalesce(F.col("tag").isin(*tags), F.lit(False)) | share)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain what the stream's source holds now into a table and return that table.

    State is split once, at the start, and not coalesced later; a draining run
    gains nothing from more splits than cores.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(wanted), spark.sparkContext.defaultParallelism))
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .format("parquet")
            .start(f"{path}/rows")
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
