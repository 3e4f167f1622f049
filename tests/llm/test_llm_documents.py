import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from fleetscope.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, ngram_model, queries, words
from fleetscope.llm.components import connected_components
from fleetscope.llm.cuckoo import CuckooFilter, buckets_for
from fleetscope.llm.decontamination import RADIUS, contaminated
from hypothesis import given, settings
from hypothesis import strategies as st

TEXT = st.text(st.sampled_from("ab é\n\t\x0bZ "), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 12))
def test_word_hashes(texts, piece):
    old, words.PIECE = words.PIECE, piece
    try:
        hashes, counts = words.word_hashes(pa.array(texts, pa.string()))
    finally:
        words.PIECE = old
    assert counts.tolist() == [len(brute.words(t)) for t in texts]
    flat = [w for t in texts for w in brute.words(t)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    shingles, n = words.shingle_hashes(hashes, counts, 3)
    want = [[tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else [] for w in map(brute.words, texts)]
    assert n.tolist() == [len(x) for x in want]
    whole = [x for own in want for x in own]
    assert len(set(zip(whole, shingles.tolist()))) == len(set(whole)) == len(set(shingles.tolist()))


def test_cuckoo_filter_is_reversible():
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = CuckooFilter(buckets_for(4000))
    made.insert(keys[:4000])
    assert made.contains(keys[:4000]).all() and made.contains(keys[4000:]).mean() < 0.01
    full = CuckooFilter(8)
    full.insert(keys[:100])
    assert full.contains(keys[:100]).all() and full.stash
    full.delete(keys[:100])
    made.delete(keys[:4000])
    assert not made.table.any() and not full.table.any() and not full.stash


def test_exact_dedup(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = exact_dedup.exact_dedup(odd_docs, counters=3).collect()
    assert len(got) == len(rows) and exact_dedup.exact_dedup(no_docs).count() == 0
    squeeze = lambda t: hashlib.sha256("".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}).encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r.text)].append(r)
    want = Counter()
    for digest, own in groups.items():
        keep = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        want.update((r.doc_id, keep.doc_id, len(own), digest) for r in own)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())


def test_misra_gries_misses_at_most_a_share(spark):
    draw = random.Random(2)
    keys = [draw.choice("aaaaabbbc") if draw.random() < 0.6 else str(draw.random()) for _ in range(6000)]
    found = exact_dedup.misra_gries(spark.createDataFrame([(k.encode(),) for k in keys], "k binary"), "k", 8)
    low = {bytes(r.k).decode(): r.at_least for r in found.collect()}
    for key, n in Counter(keys).items():
        assert n - len(keys) / 9 <= low.get(key, 0) <= n


def test_line_dedup_and_its_reversal(spark, odd_docs, no_docs, small_docs):
    docs, rows = small_docs
    for by_join in (False, True):
        index = line_dedup.LineIndex(spark, 3).insert(docs)
        got = index.drop_lines(docs, broadcast_bytes=-1 if by_join else 1 << 20)
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sorted(brute.line_dedup(rows, 3))
    half = docs.where("doc_id % 2 = 0")
    state = lambda i: (sorted(map(tuple, i.counts.collect()), key=str), sorted(bytes(r.key) for r in i.dropped().collect()))
    only = line_dedup.LineIndex(spark, 3).insert(half)
    grown = only.insert(docs.where("doc_id % 2 = 1"))
    back = grown.delete(docs.where("doc_id % 2 = 1"))
    assert state(grown) == state(index) and state(back) == state(only)
    assert sorted((r.doc_id, r.text) for r in back.drop_lines(docs).collect()) == sorted((r.doc_id, r.text) for r in only.drop_lines(docs).collect())
    out = line_dedup.line_dedup(odd_docs, min_docs=2)
    assert set(out.columns) == {*odd_docs.columns, "n_dropped"} and dict(out.dtypes)["n_lines"] == "bigint"
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.where("doc_id < 9").collect()}
    assert got[0] == (1, 0, None) and got[1] == (1, 0, "") and got[7] == (2, 1, "own a") and got[8] == (2, 1, "own b")
    assert out.count() == odd_docs.count() and line_dedup.line_dedup(no_docs).count() == 0


def test_keys_are_tried_in_batches():
    digests = [hashlib.blake2b(bytes([i]), digest_size=16).digest() for i in range(90)]
    parts = {}
    for shard in (0, 2):
        made = CuckooFilter(buckets_for(40))
        made.insert(line_dedup._as_words(digests[shard * 30 : shard * 30 + 10]))
        parts[shard] = dict(zip(("buckets", "fingerprints", "stash"), made.parts()))
    kind = pa.struct([("buckets", pa.int64()), ("fingerprints", pa.binary()), ("stash", pa.binary())])
    rows = [row for shard in range(3) for row in ([(None, shard, parts[shard])] if shard in parts else []) + [(d, shard, None) for d in digests[shard * 30 : shard * 30 + 30]]]
    pulled = []

    def batches():
        for at in range(0, len(rows), 7):
            pulled.append(at)
            key, shard, filter_ = zip(*rows[at : at + 7])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(shard, pa.int32()), pa.array(filter_, kind)], ["key", "shard", "filter"])

    out, before = [], []
    for batch in line_dedup._try_keys(batches()):
        before.append(len(pulled))
        out += batch.column(0).to_pylist()
    want = {*digests[:10], *digests[60:70]}
    assert before[0] == 1 and want <= set(out) and len(out) == len(set(out)) <= len(want) + 2


def test_language_id(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    model = language_id.train(docs.where(~docs.doc_id.isin(held)))
    got = language_id.predict(docs.where(docs.doc_id.isin(held)), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.predict(odd_docs, model).where("doc_id < 9").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3)) and odd[4].lang_pred != "und"
    assert language_id.predict(no_docs, model).count() == 0
    empty = language_id.train(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, empty).collect()} == {"und"}


def test_more_languages_than_a_mask_has_bits():
    grams = [np.arange(i * 50, i * 50 + 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(70)]
    made = language_id.LanguageFilter.build([f"l{i:02}" for i in range(70)], grams)
    assert len(made.planes) == 2 and made.score(["abc def", None])[0].shape == (2,)


def test_mixing(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [sorted(map(tuple, mixing.mix_sources(d, group=16).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    source = {r.doc_id: r.source for r in docs.collect()}
    sums, goal, most = Counter(), {}, Counter()
    for doc_id, size, source_size, target, copies, taken in runs[0]:
        assert taken == copies * size and 0 <= copies <= 3 and target <= 3 * source_size
        sums[source[doc_id]] += taken
        goal[source[doc_id]] = target
        most[source[doc_id]] = max(most[source[doc_id]], size)
    assert abs(sum(goal.values()) - sum(size for _, size, *_ in runs[0])) < 1e-3
    assert all(abs(sums[s] - goal[s]) <= 2 * most[s] for s in goal)
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and mixing.mix_sources(no_docs).count() == 0
    assert {r.taken for r in got if r.size == 0} == {0}


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 5), ("d", 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weight, left, full = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, 116.0, {}
    size = {"a": 100, "b": 1, "c": 10, "d": 0, None: 5}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in weight if x not in full) for s in weight if s not in full}
        over = [s for s in share if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            full[s] = 3.0 * size[s]
        left = 116.0 - sum(full.values())
    assert got == pytest.approx({**full, **share})


def test_rounding_keeps_chances():
    counts = np.zeros(5)
    for seed in range(4000):
        part = [0.2, 0.5, 0.7, 0.1, 0.5]
        assert mixing._settle(part, random.Random(seed)) < 0 and sum(part) == pytest.approx(2)
        counts += part
    assert np.allclose(counts / 4000, [0.2, 0.5, 0.7, 0.1, 0.5], atol=0.04)


def test_ngram_model(spark, odd_docs, no_docs, small_docs):
    docs, rows = small_docs
    some = docs.where("doc_id % 10 <> 0")
    model = ngram_model.train(some, shard_tokens=20_000)
    got = {r.doc_id: r for r in ngram_model.score(docs, model).collect()}
    want = brute.bigram_scores([t for i, t in rows if i % 10], [t for _, t in rows])
    for (name, _), w in zip(rows, want):
        r = got[name]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(w)
    wide = ngram_model.train(some, order=3)
    held = ngram_model.score(docs.where("doc_id % 10 = 0"), wide).collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = ngram_model.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.n_tokens for r in odd if not (r.text or "").strip()} == {1}
    nothing = ngram_model.train(no_docs)
    assert {(r.base_score, r.score) for r in ngram_model.score(odd_docs, nothing).collect()} == {(0.0, 0.0)}
    assert ngram_model.score(no_docs, model).count() == 0


def test_registered_model_takes_two_words_before(spark, small_docs):
    _, rows = small_docs
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    want = brute.run_scores([t for i, t in rows if not held[i]], [t for _, t in rows], 3)
    got = {r.doc_id: r for r in queries.LLM_RUNS["op1_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    assert {i: (r.held_out, r.score) for i, r in got.items()} == {i: (held[i], pytest.approx(w)) for (i, _), w in zip(rows, want)}


def test_model_takes_a_few_bytes_a_run(spark, small_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_model, "shared_folder", lambda spark, label: str(tmp_path))
    docs, rows = small_docs
    ngram_model.train(docs, order=3)
    split = [["<s>", "<s>", *brute.words(text), None] for _, text in rows]
    runs = [len({tuple(w[i : i + k]) for w in split for i in range(3 - k, len(w) - k + 1)}) for k in (1, 2, 3)]
    size = sum(file.stat().st_size for file in tmp_path.iterdir() if not file.name.startswith("stats"))
    assert size < 24 * runs[0] + 12 * runs[1] + 10 * runs[2]


@pytest.mark.parametrize("frequent", [1, 1000])
def test_high_counts_and_contexts_of_many_words(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_model, "FREQUENT", frequent)
    texts = ["a b c " * 300, *[f"a b x{i} a x{i}" for i in range(40)], "d e " * 255, "d f d f d f d"]
    docs = spark.createDataFrame([*enumerate(texts), (99, "a b unseen a b"), (100, None)], "doc_id bigint, text string")
    want = brute.run_scores(texts, [r.text for r in docs.collect()], 3)
    model = ngram_model.train(docs.where("doc_id < 99"), order=3, shard_tokens=300)
    assert [r.score for r in ngram_model.score(docs, model).orderBy("doc_id").collect()] == pytest.approx(want)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a d a", "c c a b e", "f g a b", "a b", "a b a b a c"]
    for order in (2, 3):
        model = ngram_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
        vocabulary = ngram_model.tokens_of(pa.array(["a b c d e f g unseen"]))[0]
        for prefix in ("", "a ", "a b ", "unseen "):
            head = ngram_model.tokens_of(pa.array([prefix]))[0][:-1]
            runs = np.concatenate([np.append(head, [x]) for x in vocabulary])
            p, _ = model.log10(runs, np.full(len(vocabulary), len(head) + 1))
            assert np.sum(10 ** p[len(head) :: len(head) + 1]) == pytest.approx(1)


def test_jaccard_groups(spark, odd_docs, no_docs, monkeypatch):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(140):
        own = list(base) if i % 3 else [f"v{draw.randrange(40)}" for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(8)):
            if own:
                own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[i][1].upper()) for i in range(20)] + [(300, None), (301, ""), (302, "one two"), (303, "One  two")]
    want = brute.groups(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (jaccard_join.BLOCK, 8):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
        assert got == want
    odd = jaccard_join.jaccard_groups(odd_docs)
    found = [(r.doc_id, r.component_id) for r in odd.collect()]
    assert len(found) == odd_docs.count() and found.count((10, 10)) == 3 and (77, 12) in found and (None, 11) in found
    assert jaccard_join.jaccard_groups(no_docs).count() == 0


def test_large_sets_are_told_apart_where_they_meet(spark, monkeypatch):
    draw = random.Random(8)
    shared = [f"s{i}" for i in range(900)]
    rows = [(i, " ".join([*shared, *(f"w{draw.randrange(10**6)}" for _ in range(1100 + 4 * i))])) for i in range(40)]
    rows += [(50 + i, " ".join([*rows[i][1].split()[: 1900 + 20 * i]])) for i in range(0, 40, 9)]
    given, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        given.append((pairs.count(), pairs.distinct().count()))
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.groups(rows)
    assert given[1][0] <= 40  # of 990 pairs


def test_bitmaps_go_once_to_lists_of_the_same_centre(spark, monkeypatch):
    draw = random.Random(9)
    shared, rows = [f"s{i}" for i in range(400)], []
    for i in range(60):  # near, but below the limit
        own = list(shared)
        for at in draw.sample(range(0, 400, 4), 14):
            own[at] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i][1] + " more words") for i in range(0, 60, 20)]
    sent, dealt = [], jaccard_join._dealt

    def counted(lists, *rest):
        out = dealt(lists, *rest)
        sent.extend(out.selectExpr("count(*) AS n", "count(DISTINCT node) AS nodes", "sum(size(tokens)) AS members").collect())
        return out

    monkeypatch.setattr(jaccard_join, "_dealt", counted)
    for block, together in ((jaccard_join.BLOCK, jaccard_join.TOGETHER), (8, jaccard_join.TOGETHER), (8, 1)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "TOGETHER", together)
        got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.groups(rows)
    assert sent[0].nodes >= 60 and sent[0].members > 10 * sent[0].nodes  # so many bitmaps went to the lists
    assert sent[0].n <= 4 * sent[0].nodes
    assert sent[2].n > sent[1].n > sent[0].n


def test_bitmaps_of_different_lengths(spark):
    x, y = (np.random.default_rng(i).integers(1 << 63, size=3000, dtype=np.uint64) for i in (1, 2))
    bits = lambda own, n: jaccard_join._parity(own, n).view(np.uint64)[None]
    for n in (512, 1024, 4096):
        assert jaccard_join._apart(bits(x, 4096), bits(y, n)) == jaccard_join._apart(bits(x, n), bits(y, n))
        assert jaccard_join._apart(bits(x, n), bits(y, 2048)) == jaccard_join._apart(bits(x, min(n, 2048)), bits(y, min(n, 2048)))


def test_connected_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: label[x] for a, b in edges if a != b for x in (a, b)}


def test_decontamination(spark, odd_docs, no_docs, small_docs):
    docs, rows = small_docs
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    long_item = next(t for _, t in texts if len(t.split()) > 30).split()
    edited = [*long_item[:2], "changed", *long_item[3:]]
    rows = rows + [(9001, "lead in " + " ".join(edited) + " and out"), (9002, " ".join(long_item[: len(long_item) // 2]))]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(more, items).collect()}
    want = brute.leaks(rows, texts)
    assert got == pytest.approx(want) and any(k[0] == 9001 for k in got) and not any(k[0] == 9002 for k in got)
    odd_items = spark.createDataFrame([(None, "alpha beta gamma delta omega alpha"), (2, None), (3, ""), (4, "one two")], "item_id bigint, text string")
    assert contaminated(odd_docs, odd_items).count() >= 0 and contaminated(no_docs, items).count() == 0
    assert contaminated(odd_docs, odd_items.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius():
    from fleetscope.llm import decontamination as d

    draw = random.Random(6)
    masks = set(d._near_masks())
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), RADIUS):
            b ^= 1 << bit
        cut = lambda x, i: x >> i * d.WIDTH & (1 << d.WIDTH) - 1
        assert any(cut(a, i) ^ cut(b, i) in masks for i in range(d.BLOCKS))


def test_license_scan(spark, odd_docs, no_docs, small_docs):
    docs, rows = small_docs
    text = license_scan.TEMPLATES[13][1].split()
    text[3:3] = ["inserted"]
    rows = rows + [(9001, "a b c " + " ".join(text)), (9002, "ALL rights reserved."), (9003, " ".join(text[:9]))]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.template_id): r.containment for r in got.collect()} == pytest.approx(brute.licenses(rows, license_scan.TEMPLATES))
    assert license_scan.license_scan(odd_docs).count() == 0 == license_scan.license_scan(no_docs).count()
    none = license_scan.builtin_templates(spark).limit(0)
    assert license_scan.license_scan(odd_docs, none).count() == 0
