"""Windowed statistics, gap filling and N-period alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions.text_rules import term_match
from fleetscope.operators.ordered_scan import MAX_ROWS, exact_percentile
from fleetscope.session import broadcast_if_small, materialize, small_table

SERIES = ["alarm", "series"]


def declared_alarms(spark: SparkSession) -> DataFrame:
    """The ten declared alarms as a table."""
    return small_table(spark, list(fv.ALARMS), fv.ALARM_COLUMNS)


def log_metric(lines: DataFrame, terms, period_s: int, watermark: str | None = None) -> DataFrame:
    """Matching lines per log group and period, batch or stream.

    A period with log lines but no match yields 0; a period without any line
    yields no row, because nothing was published.
    """
    if watermark:
        lines = lines.withWatermark("ts", watermark)
    matched = F.when(term_match(F.col("message"), terms), F.lit(1)).otherwise(F.lit(0))
    return (
        lines.groupBy("log_group", F.window("ts", f"{period_s} seconds").alias("w"))
        .agg(F.sum(matched).cast("double").alias("value"))
        .select("log_group", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "value")
    )


def log_metrics(lines: DataFrame, metrics: dict[str, tuple[str, ...]], period_s: int) -> DataFrame:
    """``log_metric`` of several metrics over the same lines, read and shuffled once."""
    counts = [
        F.sum(F.when(term_match(F.col("message"), terms), F.lit(1)).otherwise(F.lit(0))).cast("double").alias(name)
        for name, terms in metrics.items()
    ]
    wide = lines.groupBy("log_group", F.window("ts", f"{period_s} seconds").alias("w")).agg(*counts)
    wide = wide.select("log_group", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *metrics)
    return wide.unpivot(["log_group", "period_start", "period_end"], list(metrics), "metric", "value")


def statistic(name: str, value: Column) -> Column:
    """The aggregate for a declared statistic, for streams and bounded groups."""
    return {
        "min": F.min(value),
        "sum": F.sum(value),
        "avg": F.avg(value),
        "p90": F.percentile(value, F.lit(0.9)),
    }[name].cast("double")


def alarm_series(points: DataFrame, specs: DataFrame, match: str = "exact") -> DataFrame:
    """Points with each alarm that watches them.

    A point belongs to an alarm with its namespace and metric when its dimension
    names equal the declared ones (``exact``) or contain them (``subset``). Every
    combination of the declared dimensions' values is one series.
    """
    names = F.coalesce(F.map_keys("dims"), F.array().cast("array<string>"))
    if match == "exact":
        fits = F.array_sort(names) == F.array_sort("dim_names")
    else:
        fits = F.size(F.array_except("dim_names", names)) == 0
    pairs = F.transform(F.array_sort("dim_names"), lambda d: F.concat(d, F.lit("="), F.try_element_at("dims", d)))
    return (
        points.join(broadcast_if_small(specs), ["namespace", "metric"])
        .where(fits)
        .withColumn("series", F.array_join(pairs, ","))
        .select("alarm", "series", "stat", "period_s", "ts", "value")
    )


def metric_stat(series_points: DataFrame, specs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The declared statistic per alarm, series and tumbling period."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.col("period_s")) * F.col("period_s"))
    placed = series_points.withColumn("period_start", start)
    value = (
        F.when(F.col("stat") == "min", F.col("_min"))
        .when(F.col("stat") == "sum", F.col("_sum"))
        .when(F.col("stat") == "avg", F.col("_sum") / F.col("_n"))
    )
    out = (
        placed.where(F.col("stat") != "p90")
        .groupBy(*SERIES, "stat", "period_start")
        .agg(F.min("value").alias("_min"), F.sum("value").alias("_sum"), F.count("value").alias("_n"))
        .select(*SERIES, "period_start", value.alias("value"))
    )
    if not specs.where(F.col("stat") == "p90").isEmpty():
        high = placed.where(F.col("stat") == "p90").select(*SERIES, "period_start", "value")
        out = out.union(exact_percentile(high, [*SERIES, "period_start"], "value", 0.9, "value", max_rows))
    return out


def fill_missing(
    periods: DataFrame,
    specs: DataFrame,
    since: Column | None = None,
    until: Column | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Every period of every series, with NULL where nothing was published.

    A series runs from ``since`` (default: its own first period) to ``until``,
    exclusive (default: the end of the alarm's last period). ``expected`` adds
    series that never published; they need ``since``.
    """
    step = F.make_dt_interval(secs=F.col("period_s"))
    periods = materialize(periods, "periods")
    spans = periods.groupBy(*SERIES).agg(F.min("period_start").alias("_first"))
    if expected is not None:
        silent = expected.select(*SERIES, F.lit(None).cast("timestamp").alias("_first"))
        spans = spans.unionByName(silent).groupBy(*SERIES).agg(F.min("_first").alias("_first"))
    last = periods.groupBy("alarm").agg(F.max("period_start").alias("_last"))
    spans = spans.join(broadcast_if_small(specs.select("alarm", "period_s")), "alarm").join(
        broadcast_if_small(last), "alarm", "left"
    )
    period = F.col("period_s")
    first, stop = F.col("_first"), F.col("_last")
    if since is not None:
        first = F.timestamp_seconds(F.floor(F.unix_seconds(since) / period) * period)
    if until is not None:
        stop = F.timestamp_seconds((F.ceil(F.unix_micros(until) / (period * 1_000_000)) - 1) * period)
    grid = spans.withColumn("_from", first).withColumn("_to", stop).where(F.col("_from") <= F.col("_to"))
    grid = grid.select(*SERIES, F.explode(F.sequence("_from", "_to", step)).alias("period_start"))
    return grid.join(periods, [*SERIES, "period_start"], "left")


def breaches(value: Column) -> Column:
    """Whether a period breaches its alarm; a missing one follows the alarm's policy."""
    limit, op = F.col("threshold"), F.col("op")
    return (
        F.when(value.isNull(), F.col("missing") == "breaching")
        .when(op == "<", value < limit)
        .when(op == ">", value > limit)
        .otherwise(value >= limit)
    )


def evaluate_alarm(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """State per period: ALARM when the last n periods all breach, else OK.

    A series has one row per period here, so its size follows the time range,
    not the traffic.
    """
    order = Window.partitionBy(*SERIES).orderBy("period_start")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rules = specs.select("alarm", "n", "op", "threshold", "missing", "notify_ok")
    position = F.row_number().over(order)
    return (
        filled.join(broadcast_if_small(rules), "alarm")
        .withColumn("breach", breaches(F.col("value")))
        .withColumn("_rn", position)
        .withColumn("_calm", F.max(F.when(~F.col("breach"), F.col("_rn")).otherwise(F.lit(0))).over(so_far))
        .withColumn("state", F.when(F.col("_rn") - F.col("_calm") >= F.col("n"), F.lit("ALARM")).otherwise(F.lit("OK")))
        .withColumn("previous", F.lag("state", 1, "OK").over(order))
        .select(*SERIES, "period_start", "value", "breach", "state", "previous", "notify_ok")
    )


def alarm_transitions(evaluated: DataFrame) -> DataFrame:
    """Periods where the state changed; before the first period it is OK."""
    return evaluated.where(F.col("state") != F.col("previous"))


def alarm_actions(transitions: DataFrame) -> DataFrame:
    """Notifications due: every ALARM, and OK where the alarm declares it."""
    return transitions.where((F.col("state") == "ALARM") | F.col("notify_ok")).select(
        *SERIES, "period_start", "state", "value"
    )
