"""Compiler-cache counters: hit rate, gate and exposition rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import counter_rules as rules


def flatten_counters(docs: DataFrame) -> DataFrame:
    """One column per exported counter; ``docs`` has a VARIANT column ``doc``."""
    flat = docs.withColumn("_flat", rules.flat_counters(F.col("doc")))
    columns = {name: rules.scalar_counter(F.col("_flat"), name) for name in fv.SCALAR_COUNTERS}
    columns |= {name: rules.counter_total(F.col("_flat"), name) for name in fv.MAP_COUNTERS}
    return flat.withColumns(columns).drop("_flat", "doc")


def hit_rate(counters: DataFrame, *by: str, threshold: float = fv.HIT_RATE_GATE) -> DataFrame:
    """Hits over requests per group and whether that clears the gate; NULL without requests."""
    hits, misses = F.coalesce(F.sum("cache_hits"), F.lit(0)), F.coalesce(F.sum("cache_misses"), F.lit(0))
    totals = counters.groupBy(*by).agg(hits.alias("hits"), misses.alias("misses"))
    requests = F.col("hits") + F.col("misses")
    rate = F.when(requests > 0, F.col("hits") / requests)
    return totals.withColumn("hit_rate", rate).withColumn("passes", F.col("hit_rate") >= threshold)


def exposition_rows(counters: DataFrame, buckets: DataFrame) -> DataFrame:
    """Text exposition, one row per line, ordered by (owner, line_no).

    ``buckets``: owner, bucket, objects, size_bytes; ``counters``: owner plus the
    flattened counters. A metric appears only where its value is a number.
    """
    def block(rank: int, value: str, lines: list) -> list:
        return [F.when(F.col(value).isNotNull(), F.struct(F.lit(rank + i), line)) for i, line in enumerate(lines)]

    gauges = []
    for rank, (value, (metric, text)) in enumerate(fv.BUCKET_GAUGES.items()):
        gauges += block(
            rank * 10,
            value,
            [
                F.lit(f"# HELP {metric} {text}"),
                F.lit(f"# TYPE {metric} gauge"),
                F.format_string(metric + '{bucket="%s"} %d', "bucket", F.col(value).cast("bigint")),
            ],
        )
    totals = []
    for rank, name in enumerate((*fv.SCALAR_COUNTERS, *fv.MAP_COUNTERS)):
        metric = f"sccache_local_{name}_total"
        totals += block(
            100 + rank * 10,
            name,
            [F.lit(f"# TYPE {metric} counter"), F.format_string(metric + " %d", F.col(name).cast("bigint"))],
        )

    def stacked(df: DataFrame, rows: list) -> DataFrame:
        return df.select("owner", F.inline(F.array_compact(F.array(*rows)))).toDF("owner", "line_no", "line")

    return stacked(buckets, gauges).unionAll(stacked(counters, totals))
