"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Windows of a document that are as long as a benchmark item get a 64-bit SimHash
of their shingles. Fingerprints within a Hamming radius of an item's are found by
multi-index blocks: with ``BLOCKS`` blocks, two fingerprints at most ``RADIUS``
apart are at most RADIUS // BLOCKS apart in some block, and every value that close
to an item's block is in the index, so none is missed. Candidates are verified
by the exact similarity of weighted shingles, a shingle weighing its count.

Only windows that can pass are fingerprinted. A window as similar as asked shares
all but a few of an item's shingles, so it has one of any few more than that;
windows are laid where a document has one of these anchors, aligned with it.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.shingles import places, shared_weight, shingles, window, words
from fleetscope.session import broadcast_if_small, materialize

SIMILARITY = 0.8
BLOCKS = 5
WIDTH = 13
RADIUS = 19


def simhash(hashes: str):
    """64-bit SimHash of a list of shingle hashes: each bit by majority, a shingle counting as often as it occurs."""
    majority = f"aggregate({hashes}, 0, (s, h) -> s + cast(shiftrightunsigned(h, b) & 1 AS int) * 2 - 1) > 0"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | IF({majority}, shiftleft(1L, b), 0L))")


def _blocks(fingerprint: str):
    """(block number, value) structs of a fingerprint."""
    mask = (1 << WIDTH) - 1
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS block, shiftrightunsigned({fingerprint}, b * {WIDTH}) & {mask}L AS value))")


def _near_masks() -> list[int]:
    """All changes of a block by at most RADIUS // BLOCKS bits."""
    return [sum(1 << bit for bit in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), n)]


def item_profiles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_hashes, n, fingerprint) of items with at least five words."""
    split = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    hashed = split.select("item_id", shingles("words").alias("item_hashes")).where(F.size("item_hashes") > 0)
    return hashed.withColumns({"n": F.size("item_hashes"), "fingerprint": simhash("item_hashes")})


def anchors(profiles: DataFrame) -> DataFrame:
    """(hash, item_place, n): of each item one shingle more than a similar window can lack."""
    lacking = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n"))
    spread = F.expr("transform(item_hashes, (h, i) -> struct(xxhash64(h, i) AS turn, h AS hash, i AS item_place))")
    chosen = F.slice(F.array_sort(spread), F.lit(1), (lacking + 1).cast("int"))
    rows = profiles.select("n", F.explode(chosen).alias("a"))
    return rows.select("a.hash", "a.item_place", "n").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): windows of documents that match a benchmark item.

    Words are lower-cased runs without ASCII white space, shingles are five words;
    a match has weighted Jaccard similarity of at least 0.8. Of several windows of a
    document for an item the best, then first, is given. Items of fewer than five
    words or without an id match nothing, nor do null or empty texts. Rows with one id count as one
    document, a null id included. Other columns are not read; an empty table gives no rows.
    """
    profiles = materialize(item_profiles(items, item_col, item_text_col), "decon-items")
    split = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    hashed = split.select("doc_id", shingles("words").alias("hashes"))
    seeds = broadcast_if_small(anchors(profiles).withColumnRenamed("hash", "seed"))
    found = places(hashed, "hashes").join(seeds, F.col("hash") == F.col("seed"))
    found = found.select("doc_id", (F.col("place") - F.col("item_place")).alias("start"), "n", "hashes")
    windows = found.select("doc_id", "start", "n", window("hashes", "start", "n").alias("window")).distinct()
    windows = materialize(windows, "decon-windows")

    # a passage that many documents share is fingerprinted once
    distinct = windows.select("n", "window").distinct().withColumn("fingerprint", simhash("window"))
    asked = distinct.select("n", "window", "fingerprint", F.explode(_blocks("fingerprint")).alias("b"))
    masks = F.array(*[F.lit(mask) for mask in _near_masks()])
    near = profiles.select("item_id", "n", F.explode(_blocks("fingerprint")).alias("b"))
    near = near.select("item_id", "n", "b.block", F.explode(masks).alias("mask"), F.col("b.value").alias("own"))
    index = near.select("item_id", "n", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    asked = asked.select("n", "window", "fingerprint", "b.block", "b.value")
    pairs = asked.join(index, ["n", "block", "value"]).select("n", "window", "fingerprint", "item_id").distinct()
    prints = profiles.select("item_id", "item_hashes", F.col("fingerprint").alias("item_print"))
    pairs = pairs.join(prints, "item_id")
    pairs = pairs.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    shared = shared_weight("item_hashes", "window")
    scored = pairs.withColumn("shared", shared)
    similarity = F.col("shared") / (F.col("n") + F.size("window") - F.col("shared"))
    scored = scored.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    scored = materialize(scored.select("n", "window", "item_id", "similarity"), "decon-matches")
    matched = windows.join(scored, ["n", "window"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    out = matched.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), F.greatest(-F.col("best.before"), F.lit(0)).alias("start_word"))
