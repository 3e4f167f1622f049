"""Status documents, dependency resolution and the graph."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetscope.functions import text_rules as rules
from fleetscope.operators import components, dependencies, frontier, graph
from fleetscope.sources import readers, writers

A, B, C = "2026-01-01-a", "2026-01-02-b", "2026-01-03-c-d9"


def doc(status, deps="", body="body"):
    return f"# Title\n\n> **Status: {status} 2026-05-21.** Text.{' Depends-On: ' + deps if deps else ''}\n\n{body}\n"


@pytest.mark.parametrize(
    "text, block, word, summary, deps",
    [
        ("# T\n\n> **Status: SHIPPED 2026-05-21.** Done here.\n\nbody", "**Status: SHIPPED 2026-05-21.** Done here.", "SHIPPED", "Done here.", []),
        ("> **Status: IN PROGRESS 2026-05-21.** One\n> two\n>three\nbody", "**Status: IN PROGRESS 2026-05-21.** One\ntwo\nthree", "IN PROGRESS", "One two three", []),
        ("> **Status: NOT STARTED** - soon\n>\n> History: VETTED", "**Status: NOT STARTED** - soon\n\nHistory: VETTED", "NOT STARTED", "- soon".lstrip(".:- "), []),
        ("> note\n\n> **Status: SHIPPED.** History: VETTED", "**Status: SHIPPED.** History: VETTED", "SHIPPED", "** History: VETTED", []),
        ("plain\ntext", None, None, None, []),
        ("> **Status:** nothing known", "**Status:** nothing known", None, None, []),
        ("> **Status: DRAFT**", "**Status: DRAFT**", "DRAFT", None, []),
        (f"> **Status: VETTED.** Depends-On: {A}, {B} , {C} ,", None, "VETTED", None, [A, B, C]),
        ("> **Status: VETTED.** Depends-On: foo, bar , 2026-05-21.", None, "VETTED", None, []),
        (f"> **Status: VETTED.** Depends-On: {A}\n>\n> Elsewhere {B}.", None, "VETTED", None, [A]),
        (f"> **Status: VETTED.** Depends-On: {B} then Depends-On: {A}\n> Depends-On: {B}, {C}.", None, "VETTED", None, [B, A, C]),
        ("\U0001f600 first\r\n> **Status: PARTIAL x**\r\n> more\r\nend", "**Status: PARTIAL x**\nmore", "PARTIAL", None, []),
        ("> **Status: UNSHIPPED DRAFTS**", "**Status: UNSHIPPED DRAFTS**", None, None, []),
    ],
)
def test_text_rules(spark, text, block, word, summary, deps):
    column = rules.status_block(F.lit(text))
    got = spark.range(1).select(
        column, rules.lifecycle(column), rules.summary(column), rules.depends_on(column)
    ).first()
    if block is not None or word is None:
        assert got[0] == block
    assert got[1] == word and got[3] == deps
    if summary is not None:
        assert got[2] == summary


def test_a_very_long_block_is_read_whole(spark):
    text = "> **Status: SHIPPED**\n" + "> line\n" * 50_000 + "end"
    block = spark.createDataFrame([(text,)], "t string").select(rules.status_block(F.col("t"))).first()[0]
    assert block.count("\n") == 50_000


PLANS = [
    ("p-none", doc("VETTED"), "active", 0),
    ("p-shipped", doc("VETTED", A), "active", 0),
    ("p-draft", doc("VETTED", B), "active", 0),
    ("p-missing", doc("VETTED", "2026-09-09-gone"), "active", 0),
    ("p-mixed", doc("IN PROGRESS", f"{A}, {C}, 2026-09-09-gone"), "active", 0),
    ("p-old", doc("VETTED", "2026-01-05-old"), "active", 0),
    ("p-plain", "no block, yet Depends-On: " + A, "active", 0),
    (A, doc("SHIPPED"), "active", 0),
    (B, doc("DRAFT"), "active", 0),
    (B, doc("SHIPPED"), "archive", 1),
    (C, "> **Status:** no word", "active", 0),
    ("2026-01-05-old", doc("SUPERSEDED"), "archive", 1),
]


def plans(spark, data=PLANS):
    return spark.createDataFrame(data, "stem string, text string, location string, source_rank int")


def test_resolution(spark, rows):
    parsed = dependencies.parse_plans(plans(spark))
    resolved = dependencies.resolve_deps(parsed)
    got = {(r.plan_stem, r.stem): (r.status, r.location, r.reason) for r in resolved.collect()}
    assert got == {
        ("p-shipped", A): ("SHIPPED", "active", None),
        ("p-draft", B): ("DRAFT", "active", "not_yet_shipped"),
        ("p-missing", "2026-09-09-gone"): ("MISSING", None, "missing_file"),
        ("p-mixed", A): ("SHIPPED", "active", None),
        ("p-mixed", C): ("DRAFT", "active", "not_yet_shipped"),
        ("p-mixed", "2026-09-09-gone"): ("MISSING", None, "missing_file"),
        ("p-old", "2026-01-05-old"): ("SUPERSEDED", "archive", "terminal_blocker"),
    }
    satisfied = {r[0] for r in dependencies.all_satisfied(parsed, resolved).where("all_satisfied").collect()}
    assert satisfied == {"p-none", "p-shipped", "p-plain", A, B, C, "2026-01-05-old"}


def test_graph_keeps_question_mark_and_missing(spark, rows):
    built = graph.build_graph(plans(spark))
    status = dict(rows(built.nodes, "stem", "status"))
    assert status[C] == "?" and status["p-plain"] == "DRAFT" and status["2026-09-09-gone"] == "MISSING"
    assert rows(built.missing) == [("2026-09-09-gone",)]
    assert dict(rows(graph.in_degree(built.edges)))["2026-09-09-gone"] == 2


def make(spark, edges, status=None):
    status = status or {}
    stems = sorted({s for e in edges for s in e} | set(status))
    nodes = spark.createDataFrame([(s, status.get(s, "DRAFT"), "x") for s in stems], "stem string, status string, location string")
    table = spark.createDataFrame(edges, "src string, dst string")
    return graph.Graph(nodes, table, table.limit(0).select(F.col("dst").alias("stem")))


def test_reach(spark, rows):
    chain = make(spark, [("a", "b"), ("b", "c")])
    assert rows(graph.reachable_from(chain, "b"), "stem") == [("b",), ("c",)]
    assert rows(graph.reachable_from(chain, "ghost")) == [("ghost", "MISSING", None)]
    diamond = make(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")])
    assert rows(graph.reachable_from(diamond, "a"), "stem") == [("a",), ("b",), ("c",), ("d",)]


def test_a_long_chain_reads_few_known_nodes(spark):
    """The known nodes a chain of n reads grow with n log n, not with its square, and no node is lost or met twice."""
    n = 150
    known = frontier.Visited(spark, spark.createDataFrame([], "stem string").schema, bucket_rows=4)
    for i in range(n):
        ahead = spark.createDataFrame([(f"s{i}",), (f"s{max(0, i - 40)}",)], "stem string").distinct()
        assert [r.stem for r in known.add(ahead).collect()] == [f"s{i}"]
    assert sorted(r.stem for r in known.all().collect()) == sorted(f"s{i}" for i in range(n))
    assert known.rows_read < 25 * n and sum(map(len, known._levels)) <= 3 * known.RUNS


def test_closure_over_buckets(spark):
    random.seed(8)
    edges = sorted({(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(90)})
    seen, ahead = {"n1"}, {"n1"}
    while ahead:
        ahead = {d for s, d in edges if s in ahead} - seen
        seen |= ahead
    table = spark.createDataFrame(edges, "src string, dst string")
    found = frontier.closure(table, spark.createDataFrame([("n1",)], "stem string"), bucket_rows=3)
    assert sorted(r.stem for r in found.collect()) == sorted(seen) and len(seen) > 20
    assert frontier.closure(table, spark.createDataFrame([], "stem string")).collect() == []


def test_reached_part_has_edges_missing_and_whole_cycles(spark, rows):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "gone"), ("up", "a"), ("x", "y"), ("y", "x"), ("x", "b")]
    whole = make(spark, edges, {"gone": "MISSING", "alone": "DRAFT"})
    part = graph.reachable_subgraph(whole, "a")
    assert rows(part.nodes, "stem") == [("a",), ("b",), ("c",), ("gone",)]
    assert rows(part.edges) == [("a", "b"), ("b", "c"), ("c", "b"), ("c", "gone")] and rows(part.missing) == [("gone",)]
    found = components.cycles(whole.edges)
    assert {r.scc for r in found.collect()} == {"b", "x"}
    assert rows(graph.contained_cycles(found, part), "position", "stem") == [(0, "b"), (1, "c"), (2, "b")]
    ghost = graph.reachable_subgraph(whole, "nowhere")
    assert rows(ghost.missing) == [("nowhere",)] and rows(ghost.edges) == [] and rows(graph.contained_cycles(found, ghost)) == []


def test_visibility(spark, rows):
    status = {"done": "SHIPPED", "top": "SHIPPED", "mid": "DRAFT", "low": "SHIPPED", "leaf": "OBSOLETE", "far": "SHIPPED"}
    whole = make(spark, [("top", "mid"), ("mid", "low"), ("low", "leaf"), ("top", "far"), ("done", "far")], status)
    assert [r[0] for r in rows(graph.visible(whole))] == ["leaf", "low", "mid", "top"]
    assert graph.visible(whole, include_shipped=True).count() == 6


def test_a_shipped_item_above_one_anchor_and_below_another(spark, rows):
    status = {"x": "DRAFT", "s": "SHIPPED", "y": "DRAFT", "t": "SHIPPED"}
    whole = make(spark, [("x", "s"), ("s", "y"), ("s", "t")], status)
    assert [r[0] for r in rows(graph.visible(whole))] == ["s", "t", "x", "y"]


@pytest.mark.parametrize(
    "edges, want",
    [
        ([("a", "b"), ("b", "c")], ["a"]),
        ([("b", "c"), ("c", "b"), ("c", "a")], ["a", "b"]),  # nothing free: the smallest, then the ring
        ([("r", "x"), ("m", "n"), ("n", "m"), ("n", "o")], ["m", "r"]),  # a ring no free node reaches
        ([("r", "x"), ("z", "z")], ["r", "z"]),
    ],
)
def test_roots(spark, rows, edges, want):
    whole = make(spark, edges)
    assert [r[0] for r in rows(graph.roots(whole, whole.nodes.select("stem")))] == want


def brute_components(edges):
    ahead = {}
    for src, dst in edges:
        ahead.setdefault(src, set()).add(dst)

    def reach(start):
        seen, todo = set(), list(ahead.get(start, ()))
        while todo:
            stem = todo.pop()
            if stem not in seen:
                seen.add(stem)
                todo += ahead.get(stem, ())
        return seen

    found = {s: reach(s) for e in edges for s in e}
    return {s: min(t for t in found[s] if s in found[t]) for s in found if s in found[s]}


@pytest.mark.parametrize("size, count, seed", [(6, 3, 1), (12, 18, 2), (25, 34, 3)])
def test_components_against_brute_force(spark, size, count, seed):
    random.seed(seed)
    edges = sorted({(f"n{random.randrange(size):02d}", f"n{random.randrange(size):02d}") for _ in range(count)})
    table = spark.createDataFrame(edges, "src string, dst string")
    got = {r.stem: r.scc for r in components.strongly_connected(table).collect()}
    assert got == brute_components(edges)


def rings(df):
    out = {}
    for r in df.orderBy("scc", "cycle_no", "position").collect():
        out.setdefault((r.scc, r.cycle_no), []).append(r.stem)
    return sorted(out.values())


def test_cycles(spark):
    edges = [("x", "a"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("s", "s"), ("d", "e")]
    table = spark.createDataFrame(edges, "src string, dst string")
    assert rings(components.cycles(table)) == [["a", "b", "a"], ["s", "s"]]
    assert {r.stem for r in components.cyclic_nodes(table).collect()} == set("abcs")
    assert components.cycles(table.where("src = 'd'")).count() == 0


def test_two_rings_in_a_component_give_the_shortest(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "e"), ("e", "a"), ("m", "n"), ("n", "m")]
    table = spark.createDataFrame(edges, "src string, dst string")
    assert rings(components.cycles(table)) == [["a", "b", "e", "a"], ["m", "n", "m"]]


def test_a_long_ring_is_whole(spark):
    edges = [(f"n{i:02d}", f"n{(i + 1) % 40:02d}") for i in range(40)]
    table = spark.createDataFrame(edges, "src string, dst string")
    assert rings(components.cycles(table)) == [[*(a for a, _ in edges), "n00"]]


def test_files(spark, rows, tmp_path):
    active, archive = tmp_path / "my plans", tmp_path / "old"
    active.mkdir(), archive.mkdir(), (active / "sub").mkdir()
    (active / f"{A}.md").write_text(doc("DRAFT", B))
    (active / f"{B}.md").write_text(doc("SHIPPED"))
    (active / "notes.txt").write_text("ignored")
    (active / "sub" / "deep.md").write_text("ignored")
    (archive / f"{A}.md").write_text(doc("SHIPPED"))
    docs = readers.scan_plan_docs(spark, str(active), str(archive))
    assert rows(docs, "stem", "source_rank") == [(A, 0), (A, 1), (B, 0)]
    assert rows(dependencies.parse_plans(docs), "stem", "status") == [(A, "DRAFT"), (B, "SHIPPED")]
    assert readers.scan_plan_docs(spark, str(active), str(tmp_path / "absent")).count() == 2
    with pytest.raises(AnalysisException):
        readers.scan_plan_docs(spark, str(tmp_path / "absent")).count()
    built = graph.build_graph(docs)
    writers.write_graph(built, components.cycles(built.edges), str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out" / "edges")), "from", "to") == [(A, B)]


def test_loops_broadcast_little(spark, rows, monkeypatch):
    """Joins of a search keep to a small limit, as what they broadcast adds up in the driver; 10 MB each before."""
    name, seen = "spark.sql.autoBroadcastJoinThreshold", []
    add = frontier.Visited.add
    monkeypatch.setattr(frontier.Visited, "add", lambda self, ahead: seen.append(int(spark.conf.get(name))) or add(self, ahead))
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(frontier.closure(edges, spark.createDataFrame([("a",)], "stem string"))) == [("a",), ("b",), ("c",)]
    assert len(seen) == 4 and set(seen) == {256 << 10}
    assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == 10 << 20
