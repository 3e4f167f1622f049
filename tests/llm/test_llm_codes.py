"""Vector codes, spelling variants and packing against plain versions, with odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fleetscope.llm import packing, spelling, vector_codes
from fleetscope.llm.queries import LLM_RUNS
from fleetscope.llm.tokens import Encoder
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width, high", [(16, 50), (5, 9), (1, 3), (16, 2**40)])
def test_nearest_is_exact(width, high):
    draw = np.random.default_rng(width)
    entries, parts = draw.integers(-high, high, (60, width)), draw.integers(-high, high, (300, width))
    entries[30], parts[:60] = entries[7], entries  # ties go to the lower index
    code, error = vector_codes.nearest(parts, entries)
    apart = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in entries] for a in parts]
    assert [int(c) for c in code] == [row.index(min(row)) for row in apart]
    assert [int(e) for e in error] == [min(row) for row in apart]


def test_sequency_order_counts_sign_changes():
    table = vector_codes.walsh_hadamard(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(row) != 0).sum()) for row in table] == list(range(16))


VECTOR = "vec_id bigint, embedding array<double>, label int, code string, error int, part int, vec string"


def vector_rows(rows):
    return [(i, v, label, "x", 1, 2, "y") for i, v, label in rows]


def test_vector_codes_against_a_plain_version(spark):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)], draw.choice([1, 2, None])) for i in range(90, 0, -1)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 2)]
    rows += [(203, [float("inf")] * 8, 2), (204, [1e30] * 8, 2), (205, [1.0] * 7, 2), (206, [], None)]
    out = vector_codes.vector_codes(spark.createDataFrame(vector_rows(rows), VECTOR), entries=20)
    want = brute.vector_codes([r for r in rows if r[1] is not None and all(x is not None and abs(x) < 1e300 for x in r[1])], 20)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_vector_codes_of_no_rows_and_few_rows(spark):
    none = spark.createDataFrame([], VECTOR)
    assert vector_codes.vector_codes(none).collect() == []
    one = vector_codes.vector_codes(spark.createDataFrame(vector_rows([(5, [1.0] * 4, None)]), VECTOR)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(5, "00000000", 0, 0)]
    odd = vector_codes.vector_codes(spark.createDataFrame(vector_rows([(5, [1.0] * 3, None)]), VECTOR)).collect()
    assert [(r.vec_id, r.code, r.error) for r in odd] == [(5, None, None)]


def test_spelling_variants_against_a_plain_version(spark):
    draw = random.Random(2)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(1, 9))) for _ in range(900)}
    words |= {"a" * n for n in range(1, 30)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150, "÷×ÿÀÖ", "÷×ÿÀO"}
    counts = {w: draw.randrange(1, 40) for w in words}
    rows = [(w, n, "a", "b", 1, 2) for w, n in counts.items()] + [(None, 9, "a", "b", 1, 2), ("", 3, "a", "b", 1, 2)]
    table = spark.createDataFrame(rows, "word string, n int, form string, root string, number int, at int")
    got = {r.word: tuple(r) for r in spelling.spelling_variants(table).collect()}
    assert got.pop(None) == (None, None, None, 9, 0, None) and got.pop("") == ("", None, "", 3, 0, None)
    assert got == brute.spelling(counts)


def test_op12_on_the_given_documents(spark, small_docs, monkeypatch):
    monkeypatch.setattr(spelling, "SALT_WORDS", 3)
    docs, rows = small_docs
    counts = Counter()
    for doc_id, text in rows:
        counts.update(brute.misspelt(doc_id, run) for run in brute.letter_runs(text))
    want = brute.spelling({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = {r.word: tuple(r) for r in LLM_RUNS["op12_spelling_variants"](spark, FOLDER).collect()}
    assert got == want and any(row[1] for row in want.values())


def test_words_of_odd_documents(spark, odd_docs, no_docs):
    count = lambda docs: {r.word: r.n for r in spelling.word_counts(spelling.misspelt(spelling.lettered_words(docs, "doc_id", "text"), 2), 1, 1).collect()}
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        want.update(w for run in brute.letter_runs(r.text) if (w := brute.misspelt("" if r.doc_id is None else r.doc_id, run, 2)))
    assert count(odd_docs) == want and count(no_docs) == {}
    assert spelling.spelling_variants(spelling.word_counts(spelling.lettered_words(no_docs, "doc_id", "text"), 5, 3)).collect() == []


def test_tokens_equal_whole_texts():
    model = Tokenizer.from_file(PATH)
    draw = random.Random(7)
    signs = [" ", "\n", "a", "b", "'", "s", ".", "é", "1", "\t", "<|endoftext|>", "Z", "漢", "\xa0", ",", " re", "\r", "\x1c", "​", "🙂", "don't"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(25))) for _ in range(4000)] + [None, "", "x" * 50_000]
    ids, counts = Encoder(open(PATH, encoding="utf-8").read()).encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == model.encode(text or "", add_special_tokens=False).ids, text


def test_words_are_learnt_once_and_together():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeéü") for _ in range(8)) for _ in range(350_000)]
    encoder, given = Encoder(open(PATH, encoding="utf-8").read()), []
    whole = encoder._whole
    encoder._whole = lambda text: given.append(text) or whole(text)
    for again in (1, 2):
        for part in (words[:120_000], words[120_000:240_000], words[240_000:]):
            ids, _ = encoder.encode(pa.array([" ".join(part)]))
    assert ids.tolist() == list(whole(" ".join(words[240_000:])))
    assert sum(map(len, given)) < 1.1 * sum(len(word) + 1 for word in set(words)) and not any("\n" in text for text in given)


def check_packing(rows, docs, capacity, end=2):
    """Every document is there as it is, and every sequence is gapless and not too long; returns the sequences."""
    model, pieces, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, end]
        first = len(ids) % capacity or capacity
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
            want[doc_id].append((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert set(pieces) == set(want)
    for doc_id, found in pieces.items():
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want[doc_id])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return sequences


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, capacity=100, group=20).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], 100)
    at_once = packing.best_fit(np.array([r.length for r in rows]), 100).max() + 1
    assert len(sequences) <= at_once + 2
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack(no_docs, PATH).collect() == []


def test_op13_on_the_given_documents(spark, small_docs):
    rows = LLM_RUNS["op13_best_fit_packing"](spark, FOLDER).collect()
    sequences = check_packing(rows, small_docs[1], 1024)
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_swaps_empty_bins_that_best_fit_leaves():
    assert len(set(packing.local_search(np.array([6, 5, 5, 4]), np.arange(4), 10))) == 2
    draw, saved = np.random.default_rng(4), 0
    for _ in range(20):
        lengths = draw.integers(150, 520, 120)
        start = packing.best_fit(lengths, 1024)
        bins = packing.local_search(lengths, start, 1024)
        before, fill = np.bincount(start, lengths), np.bincount(bins, lengths)
        assert fill.max() <= 1024 and (fill**2).sum() >= (before**2).sum()
        saved += (before > 0).sum() - (fill > 0).sum()
    assert saved > 0


def test_packing_of_many_lengths_in_groups(spark):
    draw = np.random.default_rng(3)
    lengths = np.concatenate([draw.integers(1, 1025, 3000), np.full(1500, 342), draw.integers(500, 600, 500)])
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "key bigint, length bigint")
    rows = packing.pack_lengths(items, 1024, group=700).collect()
    assert sorted((r.key, r.length) for r in rows) == sorted((i, int(n)) for i, n in enumerate(lengths))
    fill = Counter()
    for r in rows:
        fill[r.bin] += r.length
    at_once = packing.best_fit(lengths, 1024).max() + 1
    assert max(fill.values()) <= 1024 and len(fill) <= 1.01 * at_once
    assert packing.pack_lengths(items.where(F.col("length") < 0)).collect() == []
