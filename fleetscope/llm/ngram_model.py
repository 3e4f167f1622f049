"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by workers.

Training counts words, as 64-bit hashes, and numbers them, frequent words first. Then it
counts runs of ``order`` words: every task sends its distinct runs, sorted and compressed,
to the shard of their first word. A shard writes its runs as a sorted table and sends the
number of distinct first words of every shorter run one level down. A table holds 4 bytes
for every word of a run but the first, and one for its count; the totals of a context are
added up from its runs, and only written for contexts of many runs. Scoring tasks map these
files and search them, so a task holds its own texts and nothing of the model.

Runs that begin with frequent words are spread over all shards by the words that
follow. The totals of contexts of frequent words alone are added up from the shards' parts.
"""

from __future__ import annotations

import os
import pickle
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.shared import share_model
from fleetscope.llm.words import by_bytes, join_hashes, word_hashes
from fleetscope.session import materialize, scratch_path

END = np.uint64(0x5DEECE66D1234567)
#: The number of the mark before a text; words are numbered from 1.
BEGIN = 0
#: Running words for each shard, about; sets what a task holds.
SHARD_TOKENS = 4_000_000
#: A word that is one of so many running words is frequent; at most so many are.
FREQUENT = 1_000
#: Running words whose distinct runs a task collects before it sends them.
HELD_TOKENS = 3_000_000
#: Contexts of more different words than that have their totals written.
FEW = 16
#: Counts from here on are written beside the table.
HIGH = 255
_WORD = [np.uint64, np.uint32, np.uint64]
_FOLLOWS = [np.uint32]
_STATS = [np.uint64, np.int64, np.int64, np.int64, np.int64]
_BLOB = "shard int, n bigint, runs binary"


def _table(k: int) -> list:
    """Kinds of a shard's arrays: first words, where their runs begin, the other words, counts; high counts; contexts of many words."""
    return [np.uint32] * (k + 1) + [np.uint8] + [np.uint32, np.uint64] + [np.uint32, np.uint64, np.uint32, np.uint32, np.uint32]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir as a mounted path, which memory mapping needs."""
    path = urlparse(scratch_path(spark, label))
    if path.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir has to be a folder that is mounted on all machines")
    os.makedirs(path.path, exist_ok=True)
    return path.path


def _save(path: str, arrays: list[np.ndarray], kinds: list) -> None:
    """Writes the arrays' lengths, then the arrays; the name appears when the file is whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(np.array([len(array) for array in arrays], np.int64).data)
        for array, kind in zip(arrays, kinds):
            out.write(np.ascontiguousarray(array, kind).tobytes())
            out.write(bytes(-out.tell() % 8))
    os.replace(part, path)


def _mapped(path: str, kinds: list) -> list[np.ndarray]:
    if not os.path.exists(path):
        return [np.zeros(0, kind) for kind in kinds]
    whole, at, out = np.memmap(path, np.uint8, "r"), 8 * len(kinds), []
    for rows, kind in zip(np.array(whole[:at]).view(np.int64), kinds):
        end = at + int(rows) * np.dtype(kind).itemsize
        out.append(whole[at:end].view(np.ndarray).view(kind))
        at = end + -end % 8
    return out


def _by_shard(shards: np.ndarray):
    """Places of every shard that occurs, in their order."""
    order = np.argsort(shards, kind="stable")
    bounds = np.flatnonzero(np.diff(shards[order], prepend=-1))
    return np.split(order, bounds[1:]) if len(order) else []


def _within(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, after: bool = False) -> np.ndarray:
    """Where ``value`` stands, or would, in the sorted part from ``low`` to ``high`` of a column; or the end of its rows."""
    out, row = low.copy(), np.flatnonzero(low < high)
    low, high, value = low[row], high[row], value[row]
    while len(row):
        middle = (low + high) >> 1
        found = column.take(middle)
        up = found <= value if after else found < value
        low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
        going = low < high
        if not going.all():
            out[row[~going]] = low[~going]
            row, low, high, value = row[going], low[going], high[going], value[going]
    return out


def _found(path: str, k: int, runs: list[np.ndarray]) -> list[np.ndarray]:
    """Count of every run, of sorted ones, in a shard's table, and of its context the total and the runs found once, twice and more often."""
    firsts, starts, *columns, counts, high_at, high_count, many_at, total, one, two, more = _mapped(path, _table(k))
    out = np.zeros(len(runs[0]), np.int64)
    if not len(firsts):
        return [out] * 5

    def count_at(places):
        found = counts[places].astype(np.int64)
        often = np.flatnonzero(found == HIGH)
        found[often] = high_count[np.searchsorted(high_at, places[often])]
        return found

    new = np.ones(len(runs[0]), bool)
    new[1:] = np.logical_or.reduce([run[1:] != run[:-1] for run in runs[:-1]])
    context = np.cumsum(new) - 1
    words = [run[new] for run in runs[:-1]]
    at = np.minimum(np.searchsorted(firsts, words[0]), len(firsts) - 1)
    low, high = starts[at].astype(np.int64), starts[at + 1].astype(np.int64)
    high[firsts[at] != words[0]] = 0
    for column, word in zip(columns[:-1], words[1:]):
        low = _within(column, low, high, word)
        row = np.flatnonzero(low + FEW < high)
        row = row[column[low[row] + FEW] != word[row]]
        high[row] = low[row] + FEW  # most contexts have few words
        high = _within(column, low, high, word, after=True)
    size = high - low
    sums = [np.zeros(len(low), np.int64) for _ in range(4)]
    for step in range(FEW):
        row = np.flatnonzero((size > step) & (size <= FEW))
        if not len(row):
            break
        found = count_at(low[row] + step)
        for values, part in zip(sums, (found, found == 1, found == 2, found >= 3)):
            values[row] += part
    row = np.flatnonzero(size > FEW)
    if len(row) and len(many_at):
        at = np.minimum(np.searchsorted(many_at, low[row]), len(many_at) - 1)
        hit = many_at[at] == low[row]
        for values, stored in zip(sums, (total, one, two, more)):
            values[row[hit]] = stored[at[hit]]
    low, high = low[context], high[context]
    place = _within(columns[-1], low, high, runs[-1])
    row = np.flatnonzero(place < high)
    row = row[columns[-1][place[row]] == runs[-1][row]]
    out[row] = count_at(place[row])
    return [out, *(values[context] for values in sums)]


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number per text): a text's words, then one end."""
    words, counts = word_hashes(column)
    counts = counts + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(len(words) + len(counts), np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words, END
    return out, counts


def _runs(words: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For every word the ``order`` words that end with it; texts begin with begin marks."""
    starts = np.cumsum(counts) - counts
    columns = [words]
    for _ in range(order - 1):
        before = np.concatenate([[BEGIN], columns[0][:-1]]).astype(np.uint32)
        before[starts] = BEGIN
        columns.insert(0, before)
    return columns


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    return join_hashes([column.astype(np.uint64) for column in columns])


def _is_in(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] == values


def _shards_of(columns: list[np.ndarray], frequent: np.ndarray, shards: int) -> np.ndarray:
    """Shard of runs: by the first word, with every word after it as long as those before are frequent."""
    key, rows = _hashed(columns[:1]), np.arange(len(columns[0]))
    for n in range(1, len(columns)):
        rows = rows[_is_in(columns[n - 1][rows], frequent)]
        key[rows] = _hashed([column[rows] for column in columns[: n + 1]])
    return (key % np.uint64(shards)).astype(np.int64)


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by their words, places in it where a new run begins)."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, used = columns[0].astype(np.uint64), int(columns[0].max()).bit_length()
    for column in columns[1:]:
        bits = int(column.max()).bit_length()
        if used + bits > 64:  # the words so far by their rank, which is shorter
            order, first = _by_key(key)
            key[order] = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(order))))
            used = len(first).bit_length()
        key, used = key << np.uint64(bits) | column, used + bits
    return _by_key(key)


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    own = key[order]
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def _grouped(columns: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct runs in order, sums of their weights or their numbers)."""
    order, first = _sorted(columns)
    if weight is None:
        sums = np.diff(np.append(first, len(order)))
    else:
        sums = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
    return [column[order[first]] for column in columns], sums


def _packed(columns: list[np.ndarray], weight: np.ndarray, shard: np.ndarray):
    """(shard, n, blob) rows of distinct runs in order with their weights; equal bytes of the numbers lie together."""
    for own in _by_shard(shard):
        step = np.diff(columns[0][own], prepend=np.uint32(0))
        numbers = np.stack([step, *(column[own] for column in columns[1:]), weight[own].astype(np.uint32)])
        planes = numbers.view(np.uint8).reshape(len(numbers), len(own), 4).transpose(0, 2, 1)
        yield int(shard[own[0]]), len(own), pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(rows: pd.DataFrame, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts = []
    for n, blob in zip(rows["n"], rows["runs"]):
        raw = pa.decompress(blob, n * 4 * (k + 1), "zstd", asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(k + 1, 4, n).transpose(0, 2, 1)
        numbers = planes.copy().view(np.uint32).reshape(k + 1, n)
        numbers[0] = np.cumsum(numbers[0], dtype=np.uint32)
        parts.append(numbers)
    *columns, weight = np.concatenate(parts, 1)
    return columns, weight.astype(np.int64)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    shard, n, runs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(n, pa.int64()), pa.array(runs, pa.binary())], ["shard", "n", "runs"])


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in range(1, 5)]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the counts of counts."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0) for i in range(3)]


@dataclass
class Vocabulary:
    """Where the numbers of words are: a file a shard, sorted by hash. A shard numbers its words by count."""

    folder: str
    shards: int

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of distinct words, 0 where there is none."""
        numbers, counts = np.zeros(len(hashes), np.uint32), np.zeros(len(hashes), np.int64)
        shard = (hashes % np.uint64(self.shards)).astype(np.int64)
        for own in _by_shard(shard):
            stored, number, count = _mapped(f"{self.folder}/words-{shard[own[0]]}", _WORD)
            if len(stored):
                at = np.minimum(np.searchsorted(stored, hashes[own]), len(stored) - 1)
                hit = stored[at] == hashes[own]
                numbers[own[hit]], counts[own[hit]] = number[at[hit]], count[at[hit]]
        return numbers, counts

    def follows(self, numbers: np.ndarray) -> np.ndarray:
        """Of every word the number of distinct words before it."""
        out = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers)
        place, shard = np.divmod(numbers[known].astype(np.int64) - 1, self.shards)
        for own in _by_shard(shard):
            (stored,) = _mapped(f"{self.folder}/follows-{shard[own[0]]}", _FOLLOWS)
            out[known[own]] = stored[place[own]]
        return out


@dataclass
class NgramModel:
    """Where the arrays are, and what is small: totals, discounts and the totals of frequent contexts."""

    vocabulary: Vocabulary
    order: int
    shards: int
    frequent: np.ndarray
    tokens: int
    words: int
    unknown: int
    discount: dict[int, list[float]]
    spread: dict[int, list[np.ndarray]]
    pairs: int
    pair_kinds: list[int]

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def log10(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of every token."""
        own, back = np.unique(tokens, return_inverse=True)
        numbers, count = self.vocabulary.lookup(own)
        follows = self.vocabulary.follows(numbers)
        d = self.discount[1]
        p = np.full(len(own), 1.0 / (self.words + 1))
        if self.pairs:
            left = sum(x * n for x, n in zip(d, self.pair_kinds))
            p = (np.maximum(follows - _discount(d, follows), 0) + left * p) / self.pairs
        p = p[back]
        # words by their rank in the batch, as short numbers sort faster; unknown ones never meet a table's
        numbers, rank = np.unique(np.append(BEGIN, np.where(numbers > 0, numbers, self.unknown)), return_inverse=True)
        columns = _runs(rank[1:].astype(np.uint32)[back], counts, self.order)
        for k in range(2, self.order + 1):
            p = self._level(k, columns[self.order - k :], numbers.astype(np.uint32), p)
        return np.log10(p), count[back]

    def _level(self, k: int, columns: list[np.ndarray], numbers: np.ndarray, below: np.ndarray) -> np.ndarray:
        order, first = _sorted(columns)
        runs = [numbers[column[order[first]]] for column in columns]
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        shards = _shards_of(runs, self.frequent, self.shards)
        found = [np.zeros(len(first), np.int64) for _ in range(5)]
        for own in _by_shard(shards):
            path = f"{self.vocabulary.folder}/grams-{k}-{shards[own[0]]}"
            for values, part in zip(found, _found(path, k, [run[own] for run in runs])):
                values[own] = part
        spread, *sums = self.spread[k]
        common = np.flatnonzero(np.logical_and.reduce([_is_in(run, self.frequent) for run in runs[:-1]]))
        if len(spread) and len(common):
            context = _hashed([run[common] for run in runs[:-1]])
            place = np.minimum(np.searchsorted(spread, context), len(spread) - 1)
            hit = spread[place] == context
            for values, stored in zip(found[1:], sums):
                values[common[hit]] = stored[place[hit]]
        d = self.discount[k]
        count, total, *kinds = found
        left = sum(x * n for x, n in zip(d, kinds))
        above, left = np.maximum(count - _discount(d, count), 0)[back], left[back]
        total = total[back]
        return np.where(total > 0, (above + left * below) / np.maximum(total, 1), below)


def _discount(d: list[float], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _write_shard(folder: str, k: int, frequent: np.ndarray, shards: int, word_shards: int):
    """Writes one shard's table of level ``k``; gives the shorter runs with their distinct first words."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["shard"].iat[0])
        columns, counts = _grouped(*_unpacked(pdf, k))
        first = np.flatnonzero(np.diff(columns[0], prepend=columns[0][:1] + np.uint32(1)))
        new = np.zeros(len(counts), bool)
        new[first] = True
        for column in columns[1:-1]:
            new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        table = [begin, np.add.reduceat(counts, begin)]
        table += [np.add.reduceat(x.astype(np.int64), begin) for x in (counts == 1, counts == 2, counts >= 3)]
        common = np.logical_and.reduce([_is_in(column[begin], frequent) for column in columns[:-1]])
        many = ~common & (np.diff(np.append(begin, len(counts))) > FEW)
        high = np.flatnonzero(counts >= HIGH)
        arrays = [columns[0][first], np.append(first, len(counts)), *columns[1:], np.minimum(counts, HIGH)]
        _save(f"{folder}/grams-{k}-{number}", [*arrays, high, counts[high], *(x[many] for x in table)], _table(k))
        of_counts = [np.array([x], np.int64) for x in (0, *_count_of_counts(counts))]
        contexts = [_hashed([column[begin[common]] for column in columns[:-1]]), *(x[common] for x in table[1:])]
        stats = [np.concatenate([a.astype(t), b.astype(t)]) for a, b, t in zip(of_counts, contexts, _STATS)]
        _save(f"{folder}/stats-{k}-{number}", stats, _STATS)
        shorter, n = _grouped(columns[1:])
        to = (shorter[0].astype(np.int64) - 1) % word_shards if k == 2 else _shards_of(shorter, frequent, shards)
        return pd.DataFrame(list(_packed(shorter, n, to)), columns=["shard", "n", "runs"])

    return write


def _write_words(folder: str, shards: int):
    """Writes one shard's words with their numbers; gives their sums, then the most frequent ones."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        hashes = np.concatenate([np.frombuffer(blob, np.uint64, n) for n, blob in zip(pdf["n"], pdf["runs"])])
        counts = np.concatenate([np.frombuffer(blob, np.uint32, n, 8 * n) for n, blob in zip(pdf["n"], pdf["runs"])])
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
        hashes, counts = hashes[first], np.add.reduceat(counts[order].astype(np.int64), first)
        often = np.argsort(-counts, kind="stable")
        numbers = np.empty(len(often), np.int64)
        numbers[often] = np.arange(len(often)) * shards + shard + 1
        _save(f"{folder}/words-{shard}", [hashes, numbers, counts], _WORD)
        top = often[:FREQUENT]
        rows = {"number": numbers[top], "n": counts[top], "tokens": 0, "words": 0, "last": 0}
        return pd.concat([pd.DataFrame(rows), pd.DataFrame([[0, 0, counts.sum(), len(counts), numbers.max()]], columns=list(rows))])

    return write


def _read_stats(spark: SparkSession, folder: str, k: int, shards: int) -> tuple[list[int], list[np.ndarray]]:
    """Counts of counts of a level, and the totals of its frequent contexts, added up over the shards."""

    def read(batches):
        for pdf in batches:
            for number in pdf["id"]:
                key, *values = _mapped(f"{folder}/stats-{k}-{number}", _STATS)
                if len(key):
                    rows = {"head": [True] + [False] * (len(key) - 1), "key": np.array(key).view(np.int64)}
                    yield pd.DataFrame(rows | {f"v{i}": np.array(v) for i, v in enumerate(values)})

    rows = spark.range(shards).mapInPandas(read, "head boolean, key bigint, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
    sums = rows.groupBy("head", "key").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(4)]).toPandas()
    head = sums[sums["head"]]
    rest = sums[~sums["head"]]
    key = rest["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    counts = [int(head[f"v{i}"].sum()) for i in range(4)]
    return counts, [key[order], *(rest[f"v{i}"].to_numpy(np.int64)[order] for i in range(4))]


def train(docs: DataFrame, text_col: str = "text", order: int = 2, shard_tokens: int = SHARD_TOKENS) -> NgramModel:
    """Counts the texts of ``docs`` (null counts as empty) into a model of ``order`` >= 2."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "ngrams")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    vocabulary = Vocabulary(folder, max(1, -(-size // (6 * shard_tokens))))

    def count_words(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 0, 32 << 20)):
            words, n = np.unique(tokens_of(batch.column(0))[0], return_counts=True)
            shard = (words % np.uint64(vocabulary.shards)).astype(np.int64)
            parts = ((int(shard[own[0]]), len(own), words[own].tobytes() + n[own].astype(np.uint32).tobytes()) for own in _by_shard(shard))
            yield _blobs(list(parts))

    written = texts.mapInArrow(count_words, _BLOB).groupBy("shard")
    kinds = "number bigint, n bigint, tokens bigint, words bigint, last bigint"
    written = materialize(written.applyInPandas(_write_words(folder, vocabulary.shards), kinds), "ngram-words")
    sums = written.agg(*[F.coalesce(f(c), F.lit(0)).alias(c) for f, c in ((F.sum, "tokens"), (F.sum, "words"), (F.max, "last"))]).head()
    tokens = sums["tokens"]
    often = written.where(F.col("n") * FREQUENT > tokens).select("number").toPandas()["number"].to_numpy(np.int64)
    frequent = np.sort(np.append(often, BEGIN)).astype(np.uint32)
    shards = max(1, -(-tokens // shard_tokens))

    def count_runs(batches):
        held, size = [], 0

        def send():
            columns, n = _grouped([np.concatenate(x) for x in zip(*[own for own, _ in held])], np.concatenate([n for _, n in held]))
            return _blobs(list(_packed(columns, n, _shards_of(columns, frequent, shards))))

        for batch in (part for whole in batches for part in by_bytes(whole, 0)):
            found, counts = tokens_of(batch.column(0))
            own, back = np.unique(found, return_inverse=True)
            held.append(_grouped(_runs(vocabulary.lookup(own)[0][back], counts, order)))
            size += len(held[-1][1])
            if size > HELD_TOKENS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    level = texts.mapInArrow(count_runs, _BLOB)
    for k in range(order, 1, -1):
        level = level.groupBy("shard").applyInPandas(_write_shard(folder, k, frequent, shards, vocabulary.shards), _BLOB)

    def write_follows(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        (numbers,), follows = _grouped(*_unpacked(pdf, 1))
        stored = np.zeros(int(numbers.max() - 1) // vocabulary.shards + 1, np.int64)
        stored[(numbers.astype(np.int64) - 1) // vocabulary.shards] = follows
        _save(f"{folder}/follows-{shard}", [stored], _FOLLOWS)
        kinds = [*_count_of_counts(follows), int((follows >= 3).sum()), int(follows.sum())]
        return pd.DataFrame([kinds], columns=list("abcdef"))

    kinds = level.groupBy("shard").applyInPandas(write_follows, ", ".join(f"{c} bigint" for c in "abcdef"))
    kinds = kinds.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcdef"]).head()
    discount, spread = {1: discounts(list(kinds)[:4])}, {}
    for k in range(2, order + 1):
        counts, spread[k] = _read_stats(spark, folder, k, shards)
        discount[k] = discounts(counts)
    pair_kinds = [kinds["a"], kinds["b"], kinds["e"]]
    return NgramModel(vocabulary, order, shards, frequent, tokens, sums["words"], sums["last"] + 1, discount, spread, kinds["f"], pair_kinds)


def score(docs: DataFrame, model: NgramModel, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (replaced if there).

    Scores are log10 probabilities of whole texts: of the model, and of single words
    with 0.1 added to every count. A null or empty text is one end token.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = docs.drop(*added)
    at = rest.columns.index(text_col)
    shared = share_model(docs.sparkSession, model)

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole, at)):
            tokens, counts = tokens_of(batch.column(at))
            p, count = own.log10(tokens, counts)
            starts = np.cumsum(counts) - counts
            sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), own.base_log10(count), p)]
            train_tokens = np.full(len(counts), own.tokens, np.int64)
            columns = [counts.astype(np.int64), sums[0], train_tokens, sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, *added])

    fields = [T.StructField(x, T.DoubleType() if x.endswith("score") else T.LongType()) for x in added]
    return rest.mapInArrow(run, T.StructType([*rest.schema, *fields]))
