"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size times, a fraction. The
whole copies are fixed; the fractional parts are settled in pairs: mass moves at
random from one of two documents to the other until one of them is 0 or 1, and
the other goes on. A group's last document is its residual; residuals meet again
one level up, in a reduction tree over groups of bounded size. Groups hold
documents of like length, so words are balanced along with copies.
"""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.words import WHITE
from fleetscope.session import materialize

#: Documents that meet in one task.
GROUP = 4096
WEIGHTS = (1, 2, 3)
MOST = 3
_LEVEL = "doc_id string, size bigint, source string, row bigint, bin int, slot bigint, part double, open boolean"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size, and the others
    share the excess by weight. In order of most * size / weight, the sources
    before some place are full; the share of the rest follows from sums up to there.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = F.lit(float(most)) * F.col("source_size")
    by_ratio = W.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    open_share = F.max(F.when(F.col("share") * F.col("weight") <= F.col("full"), F.col("share"))).over(whole)
    return (
        sizes.withColumns({"weight": weight, "full": full})
        .withColumn("share", share)
        .withColumn("target", F.least(F.col("full"), F.coalesce(open_share, F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _snapped(p: float) -> float:
    """0 or 1 in place of what differs from it by rounding only."""
    return float(round(p)) if abs(p - round(p)) < 1e-9 else p


def _settle(part: list[float], draw: random.Random) -> int:
    """Rounds ``part`` in place, keeping its sum; the place left between 0 and 1, or -1."""
    left = -1
    for i, p in enumerate(part):
        if not 0 < p < 1:
            continue
        if left < 0:
            left = i
            continue
        a, both = part[left], part[left] + p
        if both < 1:
            first = draw.random() * both < a
            part[left], part[i] = (both, 0.0) if first else (0.0, both)
        else:
            first = draw.random() * (2 - both) < 1 - p
            part[left], part[i] = (1.0, both - 1) if first else (both - 1, 1.0)
        part[left], part[i] = _snapped(part[left]), _snapped(part[i])
        if not 0 < part[left] < 1:
            left = i if 0 < part[i] < 1 else -1
    return left


def _level(seed: int, depth: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "row"], kind="stable")
        head = pdf.iloc[0]
        name = repr((seed, depth, head["source"], int(pdf["bin"].min()), int(pdf["slot"].min())))
        draw = random.Random(hashlib.sha256(name.encode()).digest())
        part = pdf["part"].tolist()
        left = _settle(part, draw)
        pdf["part"] = part
        pdf["open"] = [i == left for i in range(len(part))]
        return pdf

    return settle


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    group: int = GROUP,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row for each row of ``docs``.

    size is the number of words (null text: 0), taken = copies * size, copies at
    most ``most``. Draws follow from the seed and the ids, so reruns agree. A null
    source is a source of its own. Rows with equal ids are separate documents.
    Rows without an id are spread by their place in the input. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("bigint").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows.withColumn("bin", F.floor(4 * F.log2(F.greatest("size", F.lit(1)))).cast("int")), "mix-sizes")
    counts = materialize(rows.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-bins")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = counts.alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source")).select(
        F.col("c.source").alias("source"),
        "bin",
        F.ceil(F.col("n") / group).alias("slots"),
        "source_size",
        "target",
    )
    plan = materialize(plan, "mix-plan")
    rate = F.col("target") / F.col("source_size")
    planned = (
        rows.alias("r")
        .join(plan.alias("p"), F.expr("r.source <=> p.source AND r.bin = p.bin"))
        .select(
            "doc_id",
            "size",
            F.col("r.source").alias("source"),
            "row",
            F.col("r.bin").alias("bin"),
            F.pmod(F.xxhash64(F.coalesce("doc_id", F.col("row").cast("string"))), "slots").alias("slot"),
            F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("part"),
            F.lit(True).alias("open"),
        )
    )
    most_slots = plan.agg(F.max("slots")).head()[0] or 1
    done, level, depth = [], planned, 0
    while True:
        last = depth > 0 and most_slots <= 1
        keys = ["source"] if last else ["source", "bin", "slot"]
        out = materialize(level.groupBy(*keys).applyInPandas(_level(seed, depth), _LEVEL), "mix-level")
        done.append(out.where("NOT open"))
        if last:
            break
        most_slots = -(-most_slots // group)
        level = out.where("open").withColumn("slot", F.floor(F.col("slot") / group))
        depth += 1
    chance = (F.xxhash64(F.lit(seed), "source", "doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    settled = out.where("open").withColumn("part", F.when(chance < F.col("part"), 1.0).otherwise(0.0))
    for more in done:
        settled = settled.unionByName(more)
    per_source = plan.select("source", "source_size", "target").distinct()
    copies = F.when(F.col("size") > 0, F.floor(rate) + F.col("part").cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return (
        settled.alias("s")
        .join(per_source.alias("t"), F.expr("s.source <=> t.source"))
        .select(F.col("doc_id").cast(docs.schema[id_col].dataType), "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
