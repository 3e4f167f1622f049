"""Incremental, reversible line dedup.

The exact state is a reference-count table: for every line key the number of
documents that hold it. Keys at or above the limit are also in cuckoo filters,
one per shard of the key space. Inserting documents adds to the counts, deleting
them subtracts; keys that cross the limit go into or out of the filters. To clean
texts, the filters turn away nearly every line, and lines that pass are looked up
among the exact counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.cuckoo import SLOTS, CuckooFilter, buckets_for
from fleetscope.llm.shared import share
from fleetscope.llm.words import WHITE, by_bytes
from fleetscope.session import materialize

_WHITE = WHITE.encode()
#: Keys a task holds before it passes its counts on.
HELD_KEYS = 200_000
#: Dropped keys of a shard, at most, when shards are laid out.
SHARD_KEYS = 500_000
#: Bytes of filters and dropped keys that may be broadcast; beyond it lines are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of text whose lines a task holds at once; a longer text is alone.
HELD = 4 << 20
_FILTER = "shard int, buckets bigint, fingerprints binary, stash binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    return line.strip(_WHITE).lower()


def key_digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def key_counts(docs: DataFrame, text_col: str, sign: int, min_chars: int) -> DataFrame:
    """(key, refs): documents that hold the key, times ``sign``."""

    def count(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                value = text.as_py()
                keys = {line_key(line) for line in (value or "").encode().split(b"\n")}
                counts.update(key_digest(key) for key in keys if len(key.decode()) >= min_chars)
                if len(counts) > HELD_KEYS:
                    yield _counts_batch(counts, sign)
                    counts = Counter()
        yield _counts_batch(counts, sign)

    text = docs.select(F.col(text_col).cast("string"))
    return text.mapInArrow(count, "key binary, refs bigint").groupBy("key").agg(F.sum("refs").alias("refs"))


def _counts_batch(counts: Counter, sign: int) -> pa.RecordBatch:
    refs = pa.array([sign * n for n in counts.values()], pa.int64())
    return pa.RecordBatch.from_pydict({"key": pa.array(counts.keys(), pa.binary()), "refs": refs})


def _shard(shards: int):
    """Shard of a key: its first three bytes as a number."""
    return (F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("int") % shards).alias("shard")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter(buckets_for(2 * len(pdf)))
    made.insert(_as_words(list(pdf["key"])))
    return pd.DataFrame([(pdf["shard"].iat[0], *made.parts())], columns=["shard", "buckets", "fingerprints", "stash"])


def _change(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    if moved.empty:
        return old
    if old.empty:
        return _build(moved[moved["up"]]) if moved["up"].any() else old
    made = CuckooFilter(*old.loc[0, ["buckets", "fingerprints", "stash"]])
    for up in (False, True):
        some = list(moved.loc[moved["up"] == up, "key"])
        if some:
            (made.insert if up else made.delete)(_as_words(some))
    return pd.DataFrame([(old["shard"].iat[0], *made.parts())], columns=["shard", "buckets", "fingerprints", "stash"])


@dataclass(frozen=True)
class LineIndex:
    """Counts and filters after some inserts and deletes; every change gives a new index.

    A key is a line without ASCII white space at its ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents are dropped.
    """

    spark: SparkSession
    min_docs: int = 10
    min_chars: int = 1
    shards: int = 0
    counts: DataFrame | None = None
    filters: DataFrame | None = None

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._update(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes documents out again; they must have been inserted with the same texts."""
        return self._update(docs, text_col, -1)

    def dropped(self) -> DataFrame:
        """(key) of every line key that is dropped, by the exact counts."""
        return self.counts.where(F.col("refs") >= self.min_docs).select("key")

    def _update(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        delta = key_counts(docs, text_col, sign, self.min_chars).select("key", "refs", F.lit(0).cast("bigint").alias("was"))
        if self.counts is not None:
            old = self.counts.select("key", "refs", F.col("refs").alias("was"))
            delta = delta.unionByName(old).groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("was").alias("was"))
        merged = materialize(delta.where("refs <> 0 OR was <> 0"), "line-counts")
        counts = merged.where("refs > 0").select("key", "refs")
        now, before = F.col("refs") >= self.min_docs, F.col("was") >= self.min_docs
        held = counts.where(now).count()
        room = 0
        if self.filters is not None:
            room = (self.filters.agg(F.sum("buckets")).head()[0] or 0) * SLOTS * 0.8
        if self.filters is None or held > room:
            shards = max(8, -(-held // SHARD_KEYS))
            filters = counts.where(now).select("key", _shard(shards)).groupBy("shard").applyInPandas(_build, _FILTER)
        else:
            shards = self.shards
            moved = merged.where(now != before).select("key", now.alias("up"), _shard(shards))
            groups = self.filters.groupBy("shard").cogroup(moved.groupBy("shard"))
            filters = groups.applyInPandas(_change, _FILTER)
        filters = materialize(filters, "line-filters")
        return LineIndex(self.spark, self.min_docs, self.min_chars, shards, counts, filters)

    def drop_lines(self, docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with dropped lines taken out of the text, and n_lines, n_dropped (replaced if there).

        n_lines counts the lines before. The other lines stay, joined by a line
        feed; a text that loses all lines is empty. A null text stays null and counts as one empty line.
        """
        held = self.dropped()
        if held.count() * 24 <= broadcast_bytes:
            return self._drop_by_broadcast(docs, text_col, held)
        return self._drop_by_join(docs, text_col, held)

    def _schema(self, docs: DataFrame) -> tuple[DataFrame, T.StructType]:
        rest = docs.drop("n_lines", "n_dropped")
        return rest, T.StructType(
            [*rest.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
        )

    def _drop_by_broadcast(self, docs: DataFrame, text_col: str, held: DataFrame) -> DataFrame:
        shards = self.shards
        filters = {r["shard"]: (r["buckets"], bytes(r["fingerprints"]), bytes(r["stash"])) for r in self.filters.collect()}
        exact = {bytes(r["key"]) for r in held.collect()}
        shared = share(self.spark, (filters, exact))
        rest, schema = self._schema(docs)
        at = rest.columns.index(text_col)

        def clean(batches):
            packed, exact = shared.value
            made = {shard: CuckooFilter(*parts) for shard, parts in packed.items()}
            for batch in (part for whole in batches for part in by_bytes(whole, at, HELD)):
                values = batch.column(at).to_pylist()
                split = [(value or "").encode().split(b"\n") for value in values]
                hit = _gone([line for lines in split for line in lines], made, exact, shards)
                texts, n_lines, n_dropped, first = [], [], [], 0
                for value, lines in zip(values, split):
                    gone = hit[first : first + len(lines)]
                    first += len(lines)
                    n_lines.append(len(lines))
                    n_dropped.append(int(gone.sum()))
                    if n_dropped[-1]:
                        value = b"\n".join(line for line, out in zip(lines, gone) if not out).decode()
                    texts.append(value)
                columns = batch.columns
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    [*batch.schema.names, "n_lines", "n_dropped"],
                )

        return rest.mapInArrow(clean, schema)

    def _drop_by_join(self, docs: DataFrame, text_col: str, held: DataFrame) -> DataFrame:
        """Each shard's keys are tried on its filter in batches, those that pass are joined with the counts, all by shuffle."""
        rest, _ = self._schema(docs)
        rows = materialize(rest.withColumn("_row", F.monotonically_increasing_id()), "line-rows")
        lines = _exploded(rows, text_col)
        filters = self.filters.select("shard", F.struct("buckets", "fingerprints", "stash").alias("filter"))
        keys = lines.select("key").distinct().select("key", _shard(self.shards), F.lit(None).cast(filters.schema["filter"].dataType).alias("filter"))
        both = keys.unionByName(filters.select(F.lit(None).cast("binary").alias("key"), "shard", "filter"))
        # a shard's filter comes before its keys, which follow in batches; no task holds them all
        both = both.repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        passed = both.select("key", "shard", "filter").mapInArrow(_try_keys, "key binary")
        gone = materialize(passed.join(held, "key", "left_semi").withColumn("_gone", F.lit(True)), "line-gone")
        marked = lines.join(gone, "key", "left").groupBy("_row").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("pos", "line")))), lambda x: x["line"]),
                "\n",
            ).alias("_kept"),
            F.count(F.lit(1)).alias("n_lines"),
            F.count("_gone").alias("n_dropped"),
        )
        joined = rows.join(marked, "_row").withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("_kept")))
        return joined.select(*rest.columns, "n_lines", "n_dropped")


def _gone(lines: list[bytes], filters: dict, exact: set, shards: int) -> np.ndarray:
    """Whether each line passes its shard's filter and is dropped by the exact counts."""
    digests = [key_digest(line_key(line)) for line in lines]
    words = _as_words(digests)
    first = np.ascontiguousarray(words[:, 0]).view(np.uint8).reshape(-1, 8).astype(np.int64)
    shard = (first[:, 0] * 65536 + first[:, 1] * 256 + first[:, 2]) % max(shards, 1)
    out = np.zeros(len(lines), bool)
    for number, filter_ in filters.items():
        places = np.flatnonzero(shard == number)
        places = places[filter_.contains(words[places])]
        out[places] = [digests[i] in exact for i in places]
    return out


def _exploded(rows: DataFrame, text_col: str) -> DataFrame:
    def split(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 1, HELD)):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pos, line in enumerate((text.as_py() or "").split("\n")):
                    out.append((row, pos, line, key_digest(line_key(line.encode()))))
            names = ["_row", "pos", "line", "key"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("_row", text_col).mapInArrow(split, "_row bigint, pos bigint, line string, key binary")


def _try_keys(batches):
    """Keys that pass their shard's filter, from rows (key, shard, filter) in which the filter of a shard comes first."""
    number, made = None, None
    for batch in batches:
        shards = batch.column(1).to_numpy()
        bounds = np.flatnonzero(np.diff(shards, prepend=-1)) if len(shards) else []
        for first, last in zip(bounds, [*bounds[1:], len(shards)]):
            if shards[first] != number:
                number, made = shards[first], None
            own = batch.slice(first, last - first)
            if own.column(2)[0].is_valid:
                made = CuckooFilter(*own.column(2)[0].as_py().values())
                own = own.slice(1)
            if made is not None and len(own):
                words = _as_words(own.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(made.contains(words)))], ["key"])


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Counts the lines of ``docs`` and drops the repeated ones; see :meth:`LineIndex.drop_lines`.

    Rows with equal ids are separate documents; no rows give no rows.
    """
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, text_col)
    return index.drop_lines(docs, text_col)
