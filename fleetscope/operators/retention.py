"""What to keep hot, warm or cold, what to evict, and who uses how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import keys
from fleetscope.operators.ordered_scan import MAX_ROWS, OrderedScan


def fifo_keep(chunks: DataFrame, cap_bytes: int = fv.WARM_SESSION_BYTES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Marks the newest chunks of each session that fit ``cap_bytes``.

    ``chunks``: session_id, seq, size and any other columns. The chunk that
    straddles the cap, and all older ones, get ``kept = false``. Chunks of one ``seq`` are taken by size.
    """
    scan = OrderedScan(chunks, ["session_id"], "seq", ("size",), descending=True, max_rows=max_rows)
    return scan.running_sum(F.col("size"), "bytes_so_far").frame.withColumn("kept", F.col("bytes_so_far") <= cap_bytes)


def tenant_fifo_keep(
    chunks: DataFrame,
    cap_bytes: int = fv.WARM_TENANT_BYTES,
    ties: tuple[str, ...] = ("session_id", "seq"),
    over_quota: str = "evict",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Adds ``action`` per chunk or object of a tenant, by arrival time ``ts``.

    ``evict``: the newest that fit stay, older ones go. ``refuse``: arrivals are
    kept until the first that overflows; it and all later ones are refused.
    """
    refuse = over_quota == "refuse"
    scan = OrderedScan(chunks, ["tenant_id"], "ts", ties, descending=not refuse, max_rows=max_rows)
    fits = F.col("bytes_so_far") <= cap_bytes
    return scan.running_sum(F.col("size"), "bytes_so_far").frame.withColumn(
        "action", F.when(fits, F.lit("keep")).otherwise(F.lit(over_quota))
    )


def usage(inventory: DataFrame, *by: str) -> DataFrame:
    """Object count and bytes per bucket or tenant."""
    return inventory.groupBy(*by).agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("size_bytes"))


def tenant_usage(inventory: DataFrame) -> DataFrame:
    """Usage per tenant; objects outside the key grammar have no tenant and do not count."""
    return usage(inventory.where(F.col("tenant_id").isNotNull()), "tenant_id")


def expire(inventory: DataFrame, as_of: Column, rules=fv.TTL_RULES) -> DataFrame:
    """Adds ``ttl_days`` and ``expired``; a row no rule covers never expires.

    ``inventory``: store, key, incomplete, created, closed_at. Rules become one
    CASE expression, so expiry is a filter and needs no join. A rule on
    ``closed_at`` leaves open sessions alone.
    """
    ttl, since = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.col("created"))
    for store, prefix, incomplete, days, clock in rules:
        covers = (
            (F.col("store") == store)
            & keys.under_prefix(F.col("key"), prefix)
            & (F.coalesce("incomplete", F.lit(False)) == F.lit(incomplete))
        )
        ttl, since = ttl.when(covers, F.lit(days)), since.when(covers, F.col(clock))
    ended = since < as_of - F.make_dt_interval(days=ttl)
    return inventory.withColumn("ttl_days", ttl).withColumn("expired", F.coalesce(ended, F.lit(False)))


def keep_latest(tags: DataFrame, n: int = fv.KEEP_TAGS) -> DataFrame:
    """The newest ``n`` tags per image.

    Spark limits each group before the shuffle, so an image with very many tags
    sends only ``n`` rows per task.
    """
    newest = Window.partitionBy("image").orderBy(F.desc("created"), F.desc("tag"))
    return tags.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def deletable_tags(tags: DataFrame, live: DataFrame, n: int = fv.KEEP_TAGS) -> DataFrame:
    """Tags beyond the newest ``n`` whose image nothing live runs on."""
    kept = keep_latest(tags, n).select("image", "tag")
    return tags.join(kept, ["image", "tag"], "left_anti").join(live.select("image_id"), "image_id", "left_anti")


def cold_manifest(parts: DataFrame) -> DataFrame:
    """One row per session with its object key, chunks, size and number of parts; ``parts`` as ``cold_objects`` gives them."""
    return (
        parts.groupBy("tenant_id", "session_id")
        .agg(
            F.sum("chunks").alias("chunks"),
            F.sum(F.octet_length("body").cast("bigint")).alias("size_bytes"),
            F.count(F.lit(1)).alias("parts"),
        )
        .withColumn("object_key", keys.cold_key(F.col("tenant_id"), F.col("session_id")))
    )


def cold_objects(chunks: DataFrame, part_bytes: int = 8 * 1024 * 1024, max_rows: int = MAX_ROWS) -> DataFrame:
    """Session bodies in sequence order, as numbered parts of about ``part_bytes``.

    Most sessions are one part. A huge session is many, so no row and no task
    has to hold it whole; its parts in order are the object.
    """
    scan = OrderedScan(chunks, ["tenant_id", "session_id"], "seq", max_rows=max_rows)
    starts = scan.running_sum(F.octet_length("bytes").cast("bigint"), "_end").frame.withColumn(
        "part_no", F.floor((F.col("_end") - F.octet_length("bytes")) / part_bytes).cast("bigint")
    )
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.hex("bytes").alias("hex"))))
    return (
        starts.groupBy("tenant_id", "session_id", "part_no")
        .agg(F.count(F.lit(1)).alias("chunks"), F.unhex(F.array_join(pieces["hex"], "")).alias("body"))
        .withColumn("object_key", keys.cold_key(F.col("tenant_id"), F.col("session_id")))
    )
