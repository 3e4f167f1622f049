"""Exact n-gram Jaccard join by filters under several global token orders.

Under any global order of tokens, two sets that are similar enough share a token
in their prefixes, and k tokens if the prefixes are k - 1 tokens longer. The first order finds candidates, an inverted index over its
prefixes; each further order has to find the same pair, as does a bound from
parity bitmaps, before the sets are compared.

Groups of near copies are not expanded into pairs. First every document is
compared with the most typical member of its posting lists, which joins most of a
group; then only pairs of different components are looked at, all of them. Lists
with the same most typical member meet in one place, so that a document's bitmap
goes there once and not with each list.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.components import connected_components
from fleetscope.llm.shared import share
from fleetscope.llm.words import by_bytes, mix, shingle_hashes, word_hashes
from fleetscope.session import broadcast_if_small, materialize

SIZE = 4
PERCENT = 85
BITS = 512
#: Bits of the bitmaps that go with posting lists, at most; larger sets have half a bit a token.
LONGEST = 1 << 15
#: Frequent shingles that every order puts last: at most so many, found in one of SAMPLE documents.
FREQUENT = 200_000
SAMPLE = 32
#: Prefixes of the further orders are longer by one in so many tokens, and have to share as many more.
DEEP = 40
#: Members of a posting list that meet in one block.
BLOCK = 1024
#: Lists of one centre meet in parts, as many as members of a list times tokens of the centre make such thousands.
TOGETHER = 128
#: Words of bitmaps that are compared at once, and pairs that wait for that.
GATHERED = 1 << 20
WAITING = 1 << 16
_NO_ID = -(1 << 62)
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def _id(id_col: str):
    """Rows without an id get one far below zero, from their place."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID) - F.monotonically_increasing_id())


def _sets(batch, size: int):
    """Sorted distinct shingle hashes of every row of a batch (id, text)."""
    hashes, counts = shingle_hashes(*word_hashes(batch.column(1)), size)
    for end, count in zip(np.cumsum(counts), counts):
        yield np.unique(hashes[end - count : end])


def _parts(batches):
    return (part for batch in batches for part in by_bytes(batch, 1, 4 << 20))


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that occur often in a sample of the documents, the most frequent last.

    They only shape the token orders; any order gives the same result.
    """

    def count(batches):
        for batch in _parts(batches):
            found = [own for own in _sets(batch, size)]
            tokens, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"token": tokens.view(np.int64), "n": n.astype(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1].copy()


def _orders(tokens: np.ndarray, sorted_frequent: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Sort keys of tokens under each global order: rare ones by a hash, then frequent ones by rank."""
    if len(sorted_frequent):
        at = np.minimum(np.searchsorted(sorted_frequent, tokens), len(sorted_frequent) - 1)
        often = sorted_frequent[at] == tokens
        last = (np.uint64(1) << np.uint64(63)) | rank[at]
    else:
        often, last = np.zeros(len(tokens), bool), tokens
    return [np.where(often, last, mix(tokens ^ seed) >> np.uint64(1)) for seed in _SEEDS]


def _parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of the tokens' low bits; a bit is set if an odd number of tokens falls on it."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, digest, first, others, bits, broad, wide) per row: set size, digest, prefixes under each order, parity bitmaps.

    ``wide`` has at least a bit per token, where that is more than ``bits`` has; ``broad`` half as many.
    """
    frequent = frequent_shingles(docs, size)
    order = np.argsort(frequent)
    shared = share(docs.sparkSession, (frequent[order], order.astype(np.uint64)))

    def profile(batches):
        names = ["id", "n", "digest", "first", "others", "bits", "broad", "wide"]
        for batch in _parts(batches):
            sizes, digests, first, others, bits, broad, wide = [], [], [], [], [], [], []
            for own in _sets(batch, size):
                n = len(own)
                lacking = n - -(-percent * n // 100)
                prefixes = []
                for number, key in enumerate(_orders(own, *shared.value) if n else [own] * len(_SEEDS)):
                    length = min(n, lacking + (max(1, n // DEEP) if number else 1))
                    some = np.argpartition(key, length - 1)[:length] if n else []
                    prefixes.append(own[some].view(np.int64))
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                first.append(prefixes[0])
                others.append(prefixes[1:])
                bits.append(_parity(own, BITS))
                broad.append(_parity(own, min(1 << (n - 1).bit_length() - 1, LONGEST)) if n > 2 * BITS else bits[-1])
                wide.append(_parity(own, 1 << (n - 1).bit_length()) if n > BITS else [])
            longs = pa.list_(pa.int64())
            columns = [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(first, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(others, pa.list_(longs)), pa.array(bits, longs), pa.array(broad, longs), pa.array(wide, longs)], names)

    kinds = "id bigint, n int, digest binary, first array<bigint>, others array<array<bigint>>, bits array<bigint>, broad array<bigint>, wide array<bigint>"
    return docs.mapInArrow(profile, kinds)


def _folded(column: str, other: str):
    """A bitmap as short as the other: bits that fall on one another are added, which keeps parity."""
    half = F.size(other)
    both = F.zip_with(F.slice(column, F.lit(1), half), F.slice(column, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(column) > half, both).otherwise(F.col(column))


def _close(percent: int, column: str = "bits"):
    """Whether the parity bitmaps of a pair allow it to be similar enough; an empty one tells nothing."""
    a, b = f"{column}a", f"{column}b"
    shorter = F.least(F.size(a), F.size(b)) > 0
    apart = F.aggregate(
        F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )
    return ~shorter | (apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))


def _with_both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``pairs`` with a node column for either end, read for the nodes in pairs only."""
    ends = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    side = nodes.select("node", column).join(ends, "node", "left_semi")
    return pairs.join(side.toDF("a", f"{column}a"), "a").join(side.toDF("b", f"{column}b"), "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs(a, b, na, nb): first the filters, then the sets themselves, computed again from the texts."""
    pairs = materialize(pairs, "jaccard-pairs")
    near = _with_both(pairs, nodes, "bits").where(_close(percent)).select("a", "b", "na", "nb")
    near = materialize(near, "jaccard-near")
    near = _with_both(near, nodes, "wide").where(_close(percent, "wide")).select("a", "b", "na", "nb")
    near = materialize(near, "jaccard-near")
    # the pair has to be found under every further order as well, by the depth of the smaller prefix
    depth = F.greatest(F.lit(1), F.floor(F.least("na", "nb") / DEEP))
    shared = F.forall(
        F.zip_with("othersa", "othersb", lambda x, y: F.size(F.array_intersect(x, y)) >= depth), lambda x: x
    )
    left = _with_both(near, nodes, "others").where(shared).select("a", "b", "na", "nb")
    left = materialize(left, "jaccard-left")
    wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest", "id"), "node")
    wanted = materialize(wanted, "jaccard-wanted")

    def sets(batches):
        for batch in _parts(batches):
            own = list(_sets(batch, size))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own]
            tokens = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), tokens], ["digest", "tokens"])

    ids = broadcast_if_small(wanted.select("id").distinct())
    found = docs.join(ids, "id", "left_semi").mapInArrow(sets, "digest binary, tokens array<bigint>")
    found = found.join(wanted.select("node", "digest"), "digest").select("node", "tokens")
    both = left.join(found.toDF("a", "ta"), "a").join(found.toDF("b", "tb"), "b")
    common = F.size(F.array_intersect("ta", "tb")).alias("shared")
    links = both.select("a", "b", "na", "nb", common)
    return links.where(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b").distinct()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places where two bitmaps differ, row by row; the longer ones are folded to the length of the others."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _cross_pairs(percent: int):
    """Pairs of different components that have a key and a token in common and whose bitmaps allow them, once a batch; rows sorted by key."""
    names = ["a", "b", "na", "nb"]

    def pairs_of(rows: list[np.ndarray], bits: pa.Array, tokens: pa.Array) -> np.ndarray:
        key, side, node, component, n = rows
        starts, words = bits.offsets.to_numpy(), bits.values.to_numpy().view(np.uint64)
        size, found = np.diff(starts), [np.zeros((0, 4), np.int64)]

        def compare(codes: list[np.ndarray]) -> None:
            i, j = np.divmod(np.unique(np.concatenate(codes)), len(key))
            for a, b in set(zip(size[i].tolist(), size[j].tolist())):  # few different lengths
                own = np.flatnonzero((size[i] == a) & (size[j] == b))
                for some in np.array_split(own, -(-len(own) * max(a, b) // GATHERED)):
                    x, y = i[some], j[some]
                    apart = _apart(words[starts[x][:, None] + np.arange(a)], words[starts[y][:, None] + np.arange(b)])
                    near = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])
                    x, y = x[near], y[near]
                    x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                    found.append(np.stack([node[x], node[y], n[x], n[y]], 1))

        # members of all lists, list by list
        ends = tokens.offsets.to_numpy()
        token, row = tokens.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(key)), np.diff(ends))
        order = np.lexsort((token, key[row]))
        token, row = token[order], row[order]
        new = (token[1:] != token[:-1]) | (key[row[1:]] != key[row[:-1]])
        number = np.concatenate([[0], np.cumsum(new)])
        waiting, pairs = [], 0
        for step in range(1, len(row)):
            at = np.flatnonzero(number[step:] == number[:-step])
            if not len(at):
                break
            i, j = row[at], row[at + step]
            ok = (component[i] != component[j])
            ok &= (side[i, 1] == 0) | (side[i, 0] != side[j, 0])
            ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            waiting.append(i[ok] * len(key) + j[ok])
            pairs += len(waiting[-1])
            if pairs > WAITING:
                compare(waiting)
                waiting, pairs = [], 0
        if pairs:
            compare(waiting)
        return np.unique(np.concatenate(found), axis=0)

    def batch_of(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column) for column in found.T.copy()], names)

    def run(batches):
        held = lists = None
        for batch in batches:
            rows = [
                batch.column(0).to_numpy(),
                np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1),
                *(batch.column(c).to_numpy() for c in (3, 4, 5)),
            ]
            if not len(rows[0]):
                continue
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            new = [batch.column(6), batch.column(7)]
            lists = new if lists is None else [pa.concat_arrays(x) for x in zip(lists, new)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield batch_of(pairs_of([x[:cut] for x in rows], *(x.slice(0, cut) for x in lists)))
                held, lists = [x[cut:] for x in rows], [x.slice(cut) for x in lists]
            else:
                held = rows
        if held is not None:
            yield batch_of(pairs_of(held, *lists))

    return run


def _posting_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, df, centre, cn): members of posting lists that have another of like size in theirs.

    ``df`` is the list's length, ``centre`` its most typical member, the one that is
    in the most and longest lists for its size, and ``cn`` the size of that.
    """
    postings = nodes.select(F.explode("first").alias("token"), F.col("n").cast("bigint").alias("n"), "node")
    by_size = W.partitionBy("token").orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= percent * F.col("n"), 100 * F.col("n") >= percent * F.lead("n").over(by_size))
    many = F.count(F.lit(1)).over(by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    postings = postings.select("*", many.alias("df"), F.greatest(*[F.coalesce(x, F.lit(False)) for x in fits]).alias("meets"))
    postings = postings.where("meets").drop("meets")
    # no join with a table of the nodes, whose plan and bytes would change with its size; structs are made after the shuffle
    typical = postings.withColumn("support", F.sum("df").over(W.partitionBy("node")) / F.col("n")).repartition("token")
    member = F.struct("support", (-F.col("node")).alias("key"), "n")
    lists = typical.withColumn("c", F.max(member).over(W.partitionBy("token")))
    return lists.select("token", "node", "n", "df", (-F.col("c.key")).alias("centre"), F.col("c.n").alias("cn"))


def _dealt(lists: DataFrame, joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, own, two, node, component, n, broad, tokens): where members of lists with different components meet.

    Lists of one centre and like length meet in one place, and long ones in blocks. Where the
    centre has many tokens or its lists many members, it has several such places, so that none
    grows without bound. A node comes once a key, with all its lists there.
    """
    marked = lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_token = W.partitionBy("token")
    marked = marked.withColumn("mixed", F.min("component").over(by_token) < F.max("component").over(by_token)).where("mixed")
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    parts = F.ceil(F.col("cn") * F.least("df", F.lit(BLOCK)) / (TOGETHER << 10)).cast("int")
    dealt = marked.withColumn("own", F.pmod(F.hash("node"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.xxhash64("centre", blocks, parts, F.pmod(F.hash("token"), parts), F.least("own", "with"), F.greatest("own", "with"))
    dealt = dealt.select(
        "token",
        key.alias("key"),
        F.col("own").cast("bigint").alias("own"),
        (F.col("own") != F.col("with")).cast("bigint").alias("two"),
        "n",
        "component",
        "node",
    )
    columns = ["key", "own", "two", "node", "component", "n"]
    dealt = dealt.repartition("node").groupBy(*columns).agg(F.collect_list("token").alias("tokens"))
    return dealt.join(nodes.select("node", "broad"), "node").select(*columns, "broad", "tokens")


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Texts are sets of distinct ``size``-word shingles, A-Z lower-cased; with fewer
    words the whole sequence is one; a text without words (or null) is empty, linked
    with nothing and its own component. Two rows link when their sets' Jaccard
    similarity is at least ``percent`` / 100. component_id is the smallest id among
    rows reachable by links. Rows without an id keep a null id, and their component
    is named by a number below -2**62 unless a row with an id is in it. Repeated rows are in one component.
    Other columns are not read; no rows give no rows.
    """
    docs = docs.select(_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(profiles(docs, size, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-profiles")
    real = F.min(F.when(F.col("id") > _NO_ID, F.col("id")))
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.coalesce(real, F.min("id")).alias("low"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")
    )
    classes = materialize(classes, "jaccard-classes")
    # rows with a set that an earlier row has
    repeated = rows.where("n > 0").select("row", "digest").join(classes.where("copies > 1"), "digest").where("row <> node")
    later = materialize(repeated.select("row"), "jaccard-repeated")
    nodes = rows.where("n > 0").join(broadcast_if_small(later), "row", "left_anti").withColumnRenamed("row", "node")
    lists = materialize(_posting_lists(nodes, percent), "jaccard-lists")

    # first round: everyone with the most typical member of each of its posting lists
    stars = lists.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("centre").alias("b"), F.col("cn").alias("nb")).where("a <> b")
    stars = stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).distinct()
    links = materialize(_verified(stars, nodes, docs, size, percent), "jaccard-links")
    joined = connected_components(links)

    # second round: pairs of different components, all of them
    dealt = _dealt(lists, joined, nodes).repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(_cross_pairs(percent), "a bigint, b bigint, na bigint, nb bigint").distinct()
    more = materialize(_verified(pairs, nodes, docs, size, percent), "jaccard-links")
    groups = connected_components(links.unionByName(more))

    members = classes.join(groups, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    lowest = members.groupBy("component").agg(F.min(F.when(F.col("low") > _NO_ID, F.col("low"))).alias("at_best"), F.max("low").alias("else"))
    named = members.join(lowest, "component").select("digest", F.coalesce("at_best", "else").alias("component_id"))
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    return out.select(
        F.when(F.col("id") > _NO_ID, F.col("id")).alias("doc_id"),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
