"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The words make a trie with unbranched chains folded into one edge, held as an edge table
(node, label, child). All words walk it at once, one edge a level, as rows of
(word, position, node, edits). While a word has no edit it follows its own edge, and from
each node on its way it leaves by other edges with its one edit just there; after that only
the edge that fits exactly is taken. A state that has an edit and used its word up at the end
of another word has found a neighbour.

A trie word leaves another one's way at a node of the folded trie and nowhere else, so no
edit is ever needed inside an edge that fits. Of two words one edit apart, the beginning they
share or the end they share is at least half of the longer one. So there are two tries, of the
words and of the reversed words, and in each a word walks its second half only, where nodes
have few edges; no node is shared by more than the words with one half in common. A pair is
found from its longer word, which lacks a character in the other, or from the word with the
smaller character. Nodes are named by 64-bit hashes of prefixes; two prefixes of one hash would
merge two nodes, which adds ways and takes none, and neighbours are compared themselves at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.words import mix
from fleetscope.session import materialize, write_step

#: Words below a node for each copy of its edges: states at a busy node are dealt to the copies.
SALT_WORDS = 4096
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lettered_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, word): every run of letters in every text, A-Z lower-cased; repeated as often as it is there."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), 0))
    words = docs.select(F.col(id_col).alias("doc_id"), runs.alias("run"))
    return words.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("word"))


def misspelt(words: DataFrame, one_in: int) -> DataFrame:
    """(word): one word in ``one_in``, chosen by a checksum of document and word, lacks a character."""
    draw = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = (draw % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words.select(F.when(draw % one_in == 0, shorter).otherwise(F.col("word")).alias("word"))


def word_counts(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the distinct words of a length and a frequency."""
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _prefixes(batches):
    """(number, at, node, next) of every prefix in the second half of every word; the whole word has no next character."""
    for batch in batches:
        if not batch.num_rows:
            continue
        points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _BASE, np.uint64))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(points)) - np.repeat(starts, sizes)], out=total[1:])
        first = (sizes - 1) // 2  # where words that are longer by one begin to look
        count = sizes - first + 1
        row = np.repeat(np.arange(len(sizes)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        node = mix(total[starts[row] + at] - total[starts[row]])
        following = np.where(at < sizes[row], np.append(points, 0)[starts[row] + at], 0)
        columns = [batch.column(0).to_numpy()[row], at.astype(np.int32), node.view(np.int64), following.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["number", "at", "node", "next"])


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, begins, ends) of words(number, word): the folded trie, where each word begins to walk, and where it ends.

    edges: node, label, child, ``ends`` if a word ends at the child, ``copies`` and ``child_copies``,
    how often the edges of either node are copied (0: it has none), ``nexts``, the characters with
    which the edges of the child begin. begins: number, pos, node, copies, ends.
    """
    steps = words.select("number", "word").mapInArrow(_prefixes, "number bigint, at int, node bigint, next int")
    steps = materialize(steps, "trie-steps")
    nodes = steps.groupBy("node").agg(
        F.min(F.nullif("next", F.lit(0))).alias("low"),
        F.max("next").alias("high"),
        F.max(F.col("next") == 0).alias("ends"),
        F.count(F.nullif("next", F.lit(0))).alias("below"),
    )
    copies = F.ceil(F.col("below") / SALT_WORDS).cast("int").alias("copies")
    nodes = nodes.where(F.col("ends") | (F.col("low") < F.col("high"))).select("node", "ends", copies)
    # a word's way over the nodes that stay, with one edge from each of them to the next
    before = W.partitionBy("number").orderBy("at")
    way = steps.select("number", "at", "node").join(nodes, "node")
    way = way.withColumns({f"from_{c}": F.lag(c).over(before) for c in ("node", "copies", "at")})
    way = materialize(way, "trie-way")
    one = F.min(F.struct("number", "from_at", "at")).alias("one")
    hops = way.where("from_node IS NOT NULL").groupBy("from_node", "node")
    edges = hops.agg(one, *[F.max(c).alias(c) for c in ("from_copies", "copies", "ends")])
    edges = edges.join(words.select(F.col("number").alias("_number"), "word"), F.col("one.number") == F.col("_number"))
    label = F.substring("word", F.col("one.from_at") + 1, F.col("one.at") - F.col("one.from_at"))
    edges = edges.select(
        F.col("from_node").alias("node"), label.alias("label"), F.col("node").alias("child"), "ends",
        F.col("from_copies").alias("copies"), F.col("copies").alias("child_copies"),
    )
    edges = materialize(edges, "trie-edges")
    ahead = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("nexts"))
    edges = edges.join(ahead, "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit("")))
    half = way.join(words.select("number", F.floor(F.length("word") / 2).alias("half")), "number").where("at >= half")
    begins = half.groupBy("number").agg(F.min_by(F.struct(F.col("at").alias("pos"), "node", "copies", "ends"), "at").alias("b"))
    ends = steps.where("next = 0").select(F.col("number").alias("near"), "node")
    return materialize(edges, "trie-edges"), begins.select("number", "b.*"), ends


def _keyed(edges: DataFrame) -> DataFrame:
    """Every edge under its node alone, for words without an edit, and under node and first character, for the others."""
    keys = F.explode(F.array(F.lit(""), F.substring("label", 1, 1))).alias("key")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    return edges.select("*", keys).select("node", "key", copy, "label", "child", "ends", "child_copies", "nexts")


def _advance(states: DataFrame, keyed: DataFrame) -> DataFrame:
    """All states one edge further: (number, word, pos, node, edits, copies, found)."""
    key = F.when(F.col("edits") == 0, F.lit("")).otherwise(F.substring("word", F.col("pos") + 1, F.lit(1)))
    at = states.withColumns({"key": key, "copy": F.pmod(F.hash("number"), F.col("copies"))}).drop("copies")
    joined = at.join(keyed, ["node", "key", "copy"])
    size, pos = F.length("label"), F.col("pos")
    rest = lambda skip, length: F.substring("word", pos + 1 + skip, length)
    own, first = rest(0, F.lit(1)), F.substring("label", 1, 1)
    tail = F.substring("label", F.lit(2), size)
    step = lambda fits, new, edits: F.when(fits, F.struct((pos + new).alias("pos"), F.lit(edits).alias("edits")))
    fits = rest(0, size) == F.col("label")
    moves = F.when(F.col("edits") == 1, F.array(step(fits, size, 1))).when(own == first, F.array(step(fits, size, 0))).otherwise(
        F.array(
            step((own != "") & (own < first) & (rest(1, size - 1) == tail), size, 1),
            step((own != "") & (rest(1, size) == F.col("label")), size + 1, 1),
        )
    )
    moved = joined.withColumn("move", F.explode(F.array_compact(moves)))
    left = F.length("word") - F.col("move.pos")
    found = F.col("ends") & (left == 1 - F.col("move.edits"))  # a word without an edit may lack its last character
    # a word that is used up has nothing to replace or leave out, and one with an edit needs an edge that fits
    fitting = F.instr("nexts", F.substring("word", F.col("move.pos") + 1, F.lit(1))) > 0
    lives = (F.col("child_copies") > 0) & (left > 0) & ((F.col("move.edits") == 0) | fitting)
    return moved.select(
        "number", "word", F.col("move.pos").alias("pos"), F.col("child").alias("node"),
        F.col("move.edits").alias("edits"), F.when(lives, F.col("child_copies")).otherwise(0).alias("copies"), found.alias("found"),
    ).where("found OR copies > 0")


def _walked(words: DataFrame) -> DataFrame:
    """(number, near) of the pairs one trie finds: a level for each edge in the second half of the word with the most."""
    edges, begins, ends = trie(words)
    keyed, spark, levels = _keyed(edges), words.sparkSession, []
    begins = begins.join(words, "number").withColumn("edits", F.lit(0))
    # a word may begin at another one's end, one character before its own
    begins = begins.withColumn("found", F.col("ends") & (F.length("word") == F.col("pos") + 1))
    states = begins.select("number", "word", "pos", "node", "edits", "copies", "found")
    path = write_step(states, "trie-level")
    while True:
        levels.append(path)
        states = spark.read.parquet(path).where("copies > 0").drop("found")
        if states.isEmpty():
            break
        path = write_step(_advance(states, keyed), "trie-level")
    found = spark.read.parquet(*levels).where("found").select("number", "node")
    return found.join(ends, "node").select("number", "near")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(number, near) of words(number, word) that differ by one inserted, deleted or replaced code point, in both directions.

    Words are distinct and not empty.
    """
    backward = words.select("number", F.reverse("word").alias("word"))
    pairs = _walked(words).unionByName(_walked(backward)).where("number <> near").distinct()
    texts = words.select("number", "word"), words.select(F.col("number").alias("near"), F.col("word").alias("other"))
    near = pairs.join(texts[0], "number").join(texts[1], "near").where(F.levenshtein("word", "other", 1) == 1)
    both = F.explode(F.array(F.struct("number", "near"), F.struct(F.col("near").alias("number"), F.col("number").alias("near"))))
    return near.select(both.alias("pair")).select("pair.*")


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) with the last form of each chain as root; the chain doubles its count at each step, so it is short."""
    links = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        above = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        links = links.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        links = materialize(links, "spelling-links")
        moved = not links.where("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            return links


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each row of counts(word, n), whose words are distinct.

    ``n_near`` counts the words one edit away. ``form`` is the one of them with the largest n,
    ties to the smallest in code-point order, if its n is at least ``ratio`` times the word's;
    else it is null, as is ``form_n``. ``root`` is reached from the word by following forms; a
    word without a form is its own. Rows with a null or empty word have no neighbours. Other
    columns are not read; no rows give no rows.
    """
    words = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("bigint").alias("n"))
    words = materialize(words.withColumn("number", F.monotonically_increasing_id()), "spelling-words")
    pairs = materialize(one_edit_pairs(words.where("word <> ''")), "spelling-pairs")
    other = words.select(F.col("number").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = pairs.join(other, "near").groupBy("number").agg(F.count(F.lit(1)).alias("n_near"), best)
    large = -F.col("best.less") >= ratio * F.col("n")
    forms = words.join(near, "number", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"),
    )
    forms = materialize(forms, "spelling-forms")
    out = forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
