"""Exact duplicates with a heavy-hitter split.

A few texts can make up a third of a corpus. Misra-Gries counters find every
digest above a share of the rows, an exact count verifies them, and their groups
are settled on the map side by a broadcast of at most ``counters + 1`` rows. All
other digests go through an ordinary shuffle, where no key is heavy any more.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.words import WHITE
from fleetscope.session import materialize

#: Counters of each Misra-Gries summary; the bound of the broadcast.
COUNTERS = 1024


def _trimmed(counts: Counter, counters: int) -> Counter:
    """At most ``counters`` keys: the (counters + 1)-th largest count is taken off every key."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def misra_gries(keys: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, at_least): summaries of all partitions, merged by adding.

    ``at_least`` lacks at most n / (counters + 1) of the true count, n being all rows.
    """

    def summarize(batches):
        counts = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = _trimmed(counts, counters)
        if counts:
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())}
            )

    partial = keys.select(F.col(key).cast("binary")).mapInArrow(summarize, "key binary, n bigint")
    return partial.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("at_least"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when identical without ASCII white space; null counts as empty.
    Of equal texts the row with most code points in the original stays, then the
    smallest id (null last). Of repeated rows with one id exactly one stays. Other
    columns of ``docs``, whatever their names, are not read; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, f"[{WHITE}]+", ""), 256))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        digest.alias("digest"),
        F.length(text).alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "exact-digests")
    total = rows.count()
    share = total / (counters + 1)
    # adding up summaries loses at most one share, so whoever has two shares is among these
    likely = F.broadcast(misra_gries(rows, "digest", counters).where(F.col("at_least") >= share).select("digest"))
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    groups = (F.count(F.lit(1)).alias("group_size"), best)
    heavy = rows.join(likely, "digest", "left_semi").groupBy("digest").agg(*groups).where(F.col("group_size") >= 2 * share)
    heavy = F.broadcast(materialize(heavy, "exact-heavy"))
    rest = rows.join(heavy, "digest", "left_anti")
    settled = rows.join(heavy, "digest").unionByName(rest.join(rest.groupBy("digest").agg(*groups), "digest"))
    return settled.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
