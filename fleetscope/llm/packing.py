"""Best-fit packing of tokenised documents into sequences, improved by swaps.

Documents are tokenised and cut into pieces once, and the pieces are written with their
tokens; packing works on their keys and lengths alone. A whole piece is a sequence of its
own. The others are dealt to groups of a bounded size, and a group is packed best fit, the
longest first. Then a local search works on the sequences that are not full: it moves a
document from the emptiest one into another, or exchanges one for one or two for one, always
so that the sum of the squared fills rises, until the emptiest one is empty or nothing helps.

What is not full after a round is dealt anew, whole sequences at a time, so that they meet
others; full ones are done. Rounds end when the open sequences are as few as their tokens
allow, or a round empties none, or less than one in a thousand of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.shared import share
from fleetscope.llm.tokens import Encoder
from fleetscope.llm.words import by_bytes
from fleetscope.session import materialize, write_step

CAPACITY = 1024
END = 2
#: Documents that meet in one group.
GROUP = 16_384
#: The search in a group ends when so many of its emptiest bins in a row cannot be improved.
PATIENCE = 24
#: Bytes of text that are tokenised at once, about.
SLICE = 6 << 20


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32): the tokens of every text and ``end``, cut where longer than ``capacity``.

    Of a cut document the first piece holds what is over, all others are whole.
    """
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = share(docs.sparkSession, file.read())  # a file of a few MB

    def cut(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE):
                found, counts = encoder.encode(part.column(1))
                tokens = np.insert(found, np.cumsum(counts), end).astype(np.uint32)
                sizes = counts + 1
                n = -(-sizes // capacity)  # pieces of each row
                row = np.repeat(np.arange(len(sizes)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * capacity
                start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
                length = np.where(number == 0, first[row], capacity)
                bounds = np.append(0, np.cumsum(length))
                little = tokens.astype("<u4").tobytes()
                columns = {
                    "doc_id": part.column(0).take(pa.array(row)),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.view(np.int32))),
                    "ids_crc32": pa.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item, the longest first, each into the fullest bin that has room for it."""
    bins = np.empty(len(lengths), np.int64)
    with_room = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # which amounts of room some bin has
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        rooms = mask >> size
        if rooms:
            room = size + (rooms & -rooms).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, bin_, n = capacity, n, n + 1
        bins[item] = bin_
        with_room[room - size].append(bin_)
        mask |= 1 << (room - size)
    return bins


def _pairs_within(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one bin, by lengths that differ and once more for two that are equal; sorted by bin and length."""
    same = np.zeros(len(bins), bool)
    same[1:] = (bins[1:] == bins[:-1]) & (lengths[1:] == lengths[:-1])
    third = same.copy()
    third[1:] &= same[:-1]
    kept = np.flatnonzero(~third)  # of equal lengths in a bin, two are enough
    left, right = [], []
    for step in range(1, len(kept)):
        i = np.flatnonzero(bins[kept[step:]] == bins[kept[:-step]])
        if not len(i):
            break
        left.append(kept[i]), right.append(kept[i + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """``bins`` after moves and exchanges that raise the sum of squared fills and empty bins."""
    bins, stuck = bins.copy(), set()
    fill = np.bincount(bins, lengths).astype(np.int64)
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        if len(open_bins) < 2 or len(open_bins) == -(-int(fill[open_bins].sum()) // capacity):
            return bins
        from_ = min((int(b) for b in open_bins if int(b) not in stuck), key=lambda b: (fill[b], b), default=None)
        if from_ is None or len(stuck) >= PATIENCE:
            return bins
        is_open = np.zeros(len(fill), bool)
        is_open[open_bins] = True
        items = np.flatnonzero(is_open[bins])
        items = items[np.lexsort((lengths[items], bins[items]))]
        emptied = False
        while not emptied:
            change = _best_change(lengths, bins, fill, items, from_, capacity)
            if change is None:
                break
            out, in_, to = change
            bins[out], bins[in_] = to, from_
            moved = int(lengths[out].sum() - lengths[in_].sum())
            fill[from_] -= moved
            fill[to] += moved
            emptied = fill[from_] == 0
            items = items[np.lexsort((lengths[items], bins[items]))]
        stuck = set() if emptied else stuck | {from_}


def _best_change(lengths, bins, fill, items, from_, capacity):
    """(items out, items in, other bin): a move, else the exchange of the kind tried first that raises the squares most, or None."""
    own = items[bins[items] == from_]
    own = own[np.unique(lengths[own], return_index=True)[1]][::-1]  # one of each length, the longest first
    others = items[bins[items] != from_]
    room, over = capacity - fill[bins[others]], fill[bins[others]] - fill[from_]
    for item in own:  # a move; the fullest bin that takes it
        size = lengths[item]
        fits = np.flatnonzero((room >= size) & (over + size > 0))
        if len(fits):
            to = bins[others[fits[np.argmin(room[fits])]]]
            return np.array([item]), np.zeros(0, np.int64), to
    best, found = 0, None

    def better(gain, ok, sent, back):
        nonlocal best, found
        raised = np.where(ok, gain, 0)
        at = int(raised.argmax()) if len(raised) else 0
        if len(raised) and raised[at] > best:
            best, found = raised[at], (sent, back(at))

    for item in own:
        d = lengths[item] - lengths[others]
        better(d * (over + d), (d > 0) & (d <= room), [item], lambda at: [others[at]])
    if found is None:
        mine = items[bins[items] == from_]
        first, second = _pairs_within(bins[mine], lengths[mine])
        for a, b in zip(mine[first], mine[second]):
            d = lengths[a] + lengths[b] - lengths[others]
            better(d * (over + d), (d > 0) & (d <= room), [a, b], lambda at: [others[at]])
    if found is None:
        first, second = _pairs_within(bins[others], lengths[others])
        if len(first):
            both, pair_room, pair_over = lengths[others[first]] + lengths[others[second]], room[first], over[first]
            for item in own:
                d = lengths[item] - both
                better(d * (pair_over + d), (d > 0) & (d <= pair_room), [item], lambda at: [others[first[at]], others[second[at]]])
    if found is None:
        return None
    out, in_ = (np.array(x, np.int64) for x in found)
    return out, in_, bins[in_[0]]


def _named(keys: np.ndarray, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> pa.Table:
    """Items by bin, the longest first, with their place; a bin goes by its smallest key."""
    order = np.lexsort((keys, -lengths, bins))
    keys, lengths, bins = keys[order], lengths[order], bins[order]
    begins = np.flatnonzero(np.diff(bins, prepend=-1))
    counts = np.diff([*begins, len(bins)])
    ends = np.cumsum(lengths)
    offset = ends - lengths
    offset -= np.repeat(offset[begins], counts)
    fill = np.add.reduceat(lengths, begins)
    return pa.table(
        {
            "key": keys,
            "length": lengths,
            "bin": np.repeat(np.minimum.reduceat(keys, begins), counts),
            "offset": offset,
            "full": np.repeat(fill == capacity, counts),
        }
    )


_ITEMS = "key bigint, length bigint, bin bigint, offset bigint, full boolean"


def pack_lengths(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key, length, bin, offset) of items(key, length): bins of at most ``capacity``, as few as best fit and swaps can reach.

    Keys are distinct, lengths from 1 to ``capacity``. A bin is named by its smallest key.
    """
    spark = items.sparkSession
    whole = items.where(F.col("length") == capacity).select("key", "length", F.col("key").alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    parts = items.where(F.col("length") < capacity).select("key", "length")
    count, number, done = parts.count(), 0, []

    def first(table: pa.Table) -> pa.Table:
        order = np.argsort(table["key"].to_numpy(), kind="stable")
        keys, lengths = table["key"].to_numpy()[order], table["length"].to_numpy()[order]
        return _named(keys, lengths, local_search(lengths, best_fit(lengths, capacity), capacity), capacity)

    def again(table: pa.Table) -> pa.Table:
        order = np.argsort(table["key"].to_numpy(), kind="stable")
        keys, lengths = table["key"].to_numpy()[order], table["length"].to_numpy()[order]
        bins = np.unique(table["bin"].to_numpy()[order], return_inverse=True)[1]
        return _named(keys, lengths, local_search(lengths, bins, capacity), capacity)

    held, before = parts.withColumn("bin", F.col("key")), None
    while count:
        groups = -(-count // group)
        dealt = held.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)))
        packed = dealt.groupBy("group").applyInArrow(again if number else first, _ITEMS)
        path = write_step(packed, "packing-round")
        level = spark.read.parquet(path)
        still = level.where("NOT full").agg(F.count_distinct("bin"), F.coalesce(F.sum("length"), F.lit(0)), F.count("key")).first()
        bins, tokens, count = still
        done.append(level.where("full"))
        held = level.where("NOT full").select("key", "length", "bin")
        # as few as the tokens allow, or other groups emptied hardly any
        if bins == -(-tokens // capacity) or (before is not None and bins > before - max(1, before // 1000)):
            done.append(level.where("NOT full"))
            break
        before, number = bins, number + 1
    for level in done:
        whole = whole.unionByName(level.select("key", "length", "bin", "offset"))
    return whole


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset), a row for each piece of each document.

    A document is the tokens of its text and ``end``; a null or empty text is ``end`` alone.
    Only documents longer than ``capacity`` are cut, and all their pieces but the first are
    whole. ``sequence_id`` names the sequence a piece is in, ``offset`` its place there; no
    sequence holds more than ``capacity`` tokens, and their places have no gaps. Repeated
    rows and rows without an id are documents like others. Texts of any length are taken
    whole. Other columns are not read; no rows give no rows.
    """
    cut = pieces(docs, id_col, text_col, tokenizer, capacity, end).withColumn("key", F.monotonically_increasing_id())
    cut = materialize(cut, "packing-pieces")
    places = materialize(pack_lengths(cut.select("key", "length"), capacity, group), "packing-places")
    out = cut.join(places.select("key", "bin", "offset"), "key")
    return out.select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
