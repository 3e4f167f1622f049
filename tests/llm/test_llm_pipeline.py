import brute
import corpus_pipeline
from fleetscope.llm import queries
from fleetscope.llm.words import WHITE

import oracle
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(9001, None, "en", "src0", 0), (9002, "... 12 !", "en", "src0", 8), (None, "the of and to", "en", None, 13)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = stages["language_id"](spark, docs, FOLDER)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    assert rows - {(r.doc_id, r.text) for r in kept.collect()} == {(9001, None), (9002, "... 12 !")}

    cleaned = stages["line_dedup"](spark, kept, FOLDER)
    want = brute.line_dedup([(r.doc_id, r.text) for r in kept.collect()])
    got = cleaned.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t) for i, _, _, t in want), key=str)
    assert all(r.n_chars == len(r.text) for r in got)

    single = stages["near_duplicates"](spark, cleaned.unionByName(cleaned.limit(3)), FOLDER)
    groups = brute.groups([(r.doc_id, r.text) for r in got if r.doc_id is not None])
    assert sorted(r.doc_id for r in single.where("doc_id IS NOT NULL").collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, FOLDER)
    bad = {i for i, _ in brute.leaks([(r.doc_id, r.text) for r in single.collect()], items)}
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == bad

    mixed = stages["mixing"](spark, clean, FOLDER).collect()
    assert sorted((r.doc_id, r.size) for r in mixed if r.doc_id is not None) == sorted((r.doc_id, len(brute.words(r.text))) for r in clean.collect() if r.doc_id is not None)
    for stage in (kept, cleaned, single, clean):
        assert stage.dtypes == docs.dtypes


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    names = ["_row", "_letters", "_key", "score", "n_lines", "lang_pred", "leak", "_gone", "_kept", "key", "node"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    wide = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, FOLDER)
        assert kept.dtypes == wide.dtypes
        assert all(r[name] == f"{name}{r.doc_id}" for r in kept.collect() for name in names)
        assert stage(spark, wide.limit(0), FOLDER).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), FOLDER).collect() == []


def test_near_duplicates_are_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words))]
    for name, edits in ((2, (20, 60)), (3, (10, 40, 70)), (4, range(0, 100, 9))):
        rows.append((name, " ".join(f"{name}x{i}" if i in edits else w for i, w in enumerate(words))))
    # 10 and 11 share 32 of 40 runs of five words, 10 and 12 share 31 of 41
    short = [f"s{i}" for i in range(40)]
    rows += [(10, " ".join(short)), (11, " ".join([*short[:36], "a", "b", "c", "d"])), (12, " ".join([*short[:35], "e", "f", "g", "h", "i"]))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER)
    groups, narrow = brute.groups(rows, size=5, percent=80), brute.groups(rows)
    want = {i for i, (_, c) in groups.items() if i == c}
    assert want != {i for i, (_, c) in narrow.items() if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0 and len(WHITE) == 6


def test_queries_with_sql(spark):
    import __spark_entry__

    assert set(queries.LLM_RUNS) < set(__spark_entry__.queries())
    con = oracle.connect(FOLDER)
    for name, sql in queries.LLM_ORACLES.items():
        out = queries.LLM_RUNS[name](spark, FOLDER)
        answer = con.execute(sql)
        columns = [c[0] for c in answer.description]
        assert oracle.rows_of(out.columns, [tuple(r) for r in out.collect()]) == oracle.rows_of(columns, answer.fetchall()), name
