"""Queries over status documents and the graph between them.

The documents table becomes status documents: each text keeps its whole body
and gets a status block. One item in three depends on item 0, all depend on a
quarter-index parent, some on absent items, and some form rings of three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import components, dependencies, graph
from fleetscope.plans.registry import Tables, query, to_duckdb
from fleetscope.session import materialize

PLAN_DOCS = """
SELECT stem, '# Item' || chr(10) || chr(10) || CASE WHEN doc_id % 13 = 5 THEN '' ELSE
    '> **Status: ' || word || ' 2026-05-21.** Item of ' || source || '.' ||
    CASE WHEN deps = '' THEN '' ELSE ' Depends-On: ' || deps || '.' END || chr(10) ||
    '> History: VETTED, compare 2026-01-01-doc-1.' || chr(10) END || chr(10) || text AS text,
  'active/' || stem || '.md' AS location, 0 AS source_rank
FROM (
  SELECT doc_id, text, source, '2026-01-01-doc-' || CAST(doc_id AS STRING) AS stem,
    CASE n_chars % 40 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'IN PROGRESS' WHEN 2 THEN 'SUPERSEDED' WHEN 3 THEN 'waiting'
      ELSE 'SHIPPED' END AS word,
    concat_ws(', ',
      CASE WHEN doc_id > 0 THEN '2026-01-01-doc-' || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) END,
      CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN '2026-01-01-doc-0' END,
      CASE WHEN doc_id % 11 = 0 THEN '2027-01-01-absent-' || CAST(doc_id % 37 AS STRING) END,
      CASE WHEN doc_id % 50 IN (10, 11) THEN '2026-01-01-doc-' || CAST(doc_id + 1 AS STRING)
        WHEN doc_id % 50 = 12 THEN '2026-01-01-doc-' || CAST(doc_id - 2 AS STRING) END) AS deps
  FROM {documents})
UNION ALL
SELECT '2026-01-01-doc-' || CAST(doc_id AS STRING), '> **Status: OBSOLETE 2025-01-01.** Old copy.',
  'archive/2026-01-01-doc-' || CAST(doc_id AS STRING) || '.md', 1
FROM {documents} WHERE lang = 'fr'
"""

_WORDS = "|".join(fv.LIFECYCLE_WORDS)

_PARSED_SQL = rf"""
docs AS ({to_duckdb(PLAN_DOCS)}),
chosen AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY stem ORDER BY source_rank) = 1),
blocks AS (
  SELECT stem, location, nullif(regexp_replace(
    regexp_extract(text, '(?m)^>[^\n]*\*\*Status:[^\n]*(?:\n>[^\n]*)*'), '(?m)^> ?', '', 'g'), '') AS block FROM chosen),
parsed AS (
  SELECT stem, location, block,
    CASE WHEN block IS NULL THEN 'DRAFT' ELSE nullif(regexp_extract(block, '\b({_WORDS})\b', 1), '') END AS word,
    nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(
      regexp_extract(block, '(?s)\b(?:{_WORDS})\b(.*)', 1), '(?s)\n\s*\n.*', ''), '\s+', ' ', 'g')),
      '^\d{{4}}-\d{{2}}-\d{{2}}\.?\s*', ''), '^\*+\s*', ''), '^[.:\- ]+', '')), '') AS summary,
    coalesce(list_filter(named, lambda x, i: list_position(named, x) = i), []) AS deps
  FROM (SELECT *, regexp_extract_all(regexp_extract(block, 'Depends-On:([^\n]*)', 1),
    '\b\d{{4}}-\d{{2}}-\d{{2}}-[a-z0-9]+(?:-[a-z0-9]+)*\b') AS named FROM blocks)),
edges AS (SELECT DISTINCT stem AS src, unnest(deps) AS dst FROM parsed),
nodes AS (
  SELECT stem, coalesce(word, '?') AS status, location FROM parsed
  UNION ALL SELECT DISTINCT dst, 'MISSING', NULL FROM edges WHERE dst NOT IN (SELECT stem FROM parsed))
"""


def _plans(t: Tables) -> DataFrame:
    return t.sql(PLAN_DOCS, heavy=True)


@query(
    "plan_parse",
    f"""WITH {_PARSED_SQL} SELECT stem, location, block IS NOT NULL AS has_block, coalesce(word, 'DRAFT') AS status,
    summary, array_to_string(deps, ',') AS depends_on FROM parsed""",
)
def plan_parse(t: Tables) -> DataFrame:
    return dependencies.parse_plans(_plans(t)).withColumn("depends_on", F.array_join("depends_on", ","))


_RESOLVED_SQL = f"""
{_PARSED_SQL},
declared AS (
  SELECT stem AS plan_stem, unnest(deps) AS stem, generate_subscripts(deps, 1) - 1 AS position FROM parsed),
resolved AS (
  SELECT plan_stem, CAST(position AS INTEGER) AS position, d.stem,
    CASE WHEN p.stem IS NULL THEN 'MISSING' ELSE coalesce(p.word, 'DRAFT') END AS status, p.location, p.summary
  FROM declared d LEFT JOIN parsed p ON d.stem = p.stem),
reasoned AS (
  SELECT *, CASE status WHEN 'SHIPPED' THEN NULL WHEN 'MISSING' THEN 'missing_file'
    WHEN 'SUPERSEDED' THEN 'terminal_blocker' WHEN 'OBSOLETE' THEN 'terminal_blocker'
    ELSE 'not_yet_shipped' END AS reason FROM resolved)
"""


@query("plan_resolve", f"WITH {_RESOLVED_SQL} SELECT * FROM reasoned")
def plan_resolve(t: Tables) -> DataFrame:
    return dependencies.resolve_deps(dependencies.parsed_table(_plans(t)))


@query(
    "plan_satisfied",
    f"""WITH {_RESOLVED_SQL} SELECT parsed.stem AS plan_stem, count(reasoned.stem) AS dependencies,
    count(reason) AS unsatisfied, count(reason) = 0 AS all_satisfied
    FROM parsed LEFT JOIN reasoned ON plan_stem = parsed.stem GROUP BY ALL""",
)
def plan_satisfied(t: Tables) -> DataFrame:
    parsed = dependencies.parsed_table(_plans(t))
    return dependencies.all_satisfied(parsed, dependencies.resolve_deps(parsed))


@query("graph_nodes", f"WITH {_PARSED_SQL} SELECT stem, status, location FROM nodes")
def graph_nodes(t: Tables) -> DataFrame:
    return graph.ordered_graph(graph.build_graph(_plans(t)))[0]


@query("graph_edges", f'WITH {_PARSED_SQL} SELECT src AS "from", dst AS "to" FROM edges')
def graph_edges(t: Tables) -> DataFrame:
    return graph.ordered_graph(graph.build_graph(_plans(t)))[1]


@query("graph_missing", f"WITH {_PARSED_SQL} SELECT stem FROM nodes WHERE status = 'MISSING'")
def graph_missing(t: Tables) -> DataFrame:
    return graph.ordered_graph(graph.build_graph(_plans(t)))[2]


@query(
    "graph_in_degree",
    f"WITH {_PARSED_SQL} SELECT dst AS stem, count(DISTINCT src) AS dependants FROM edges GROUP BY dst",
)
def graph_in_degree(t: Tables) -> DataFrame:
    return graph.in_degree(graph.build_graph(_plans(t)).edges)


@query(
    "graph_reach",
    f"""WITH RECURSIVE {_PARSED_SQL},
    found AS (SELECT max(src) AS stem FROM edges UNION SELECT dst FROM found JOIN edges ON src = found.stem)
    SELECT stem, status, location FROM found JOIN nodes USING (stem)""",
)
def graph_reach(t: Tables) -> DataFrame:
    whole = graph.build_graph(_plans(t))
    last = whole.edges.agg(F.max("src")).first()[0]
    return graph.reachable_from(whole, last)


_REACH_SQL = f"""
{_PARSED_SQL},
found AS (SELECT max(src) AS stem FROM edges UNION SELECT dst FROM found JOIN edges ON src = found.stem)
"""


def _reached(t: Tables) -> graph.Graph:
    """What the last source of the graph reaches."""
    whole = graph.build_graph(_plans(t))
    return graph.reachable_subgraph(whole, whole.edges.agg(F.max("src")).first()[0])


@query("graph_reach_edges", f"WITH RECURSIVE {_REACH_SQL} SELECT src, dst FROM edges WHERE src IN (SELECT stem FROM found)")
def graph_reach_edges(t: Tables) -> DataFrame:
    return _reached(t).edges


@query(
    "graph_reach_missing",
    f"WITH RECURSIVE {_REACH_SQL} SELECT stem FROM found JOIN nodes USING (stem) WHERE status = 'MISSING'",
)
def graph_reach_missing(t: Tables) -> DataFrame:
    return _reached(t).missing


_VISIBLE_SQL = f"""
{_PARSED_SQL},
anchors AS (SELECT stem FROM nodes WHERE status NOT IN ('SHIPPED', 'SUPERSEDED', 'OBSOLETE')),
down AS (SELECT stem FROM anchors UNION SELECT dst FROM down JOIN edges ON src = down.stem),
up AS (SELECT stem FROM anchors UNION SELECT src FROM up JOIN edges ON dst = up.stem),
visible AS (SELECT stem FROM down UNION SELECT stem FROM up)
"""


@query("graph_visible", f"WITH RECURSIVE {_VISIBLE_SQL} SELECT stem FROM visible")
def graph_visible(t: Tables) -> DataFrame:
    return graph.visible(graph.build_graph(_plans(t)))


_COMPONENT_SQL = """
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b),
component AS (
  SELECT x.a AS stem, min(x.b) AS scc FROM reach x JOIN reach y ON x.b = y.a AND y.b = x.a GROUP BY x.a)
"""


@query("graph_cyclic", f"WITH RECURSIVE {_PARSED_SQL}, {_COMPONENT_SQL} SELECT stem, scc FROM component")
def graph_cyclic(t: Tables) -> DataFrame:
    return components.strongly_connected(graph.build_graph(_plans(t)).edges)


_WALK_SQL = f"""
    {_COMPONENT_SQL},
    inner_edges AS (
      SELECT s.scc, src, dst FROM edges JOIN component s ON s.stem = src JOIN component d ON d.stem = dst AND d.scc = s.scc),
    walk AS (
      SELECT DISTINCT scc, scc AS stem, 0 AS position FROM inner_edges
      UNION SELECT w.scc, e.dst, position + 1 FROM walk w JOIN inner_edges e ON e.scc = w.scc AND e.src = w.stem
        WHERE position = 0 OR w.stem <> w.scc)
"""
_CYCLE_COLUMNS = "scc, CAST(0 AS INTEGER) AS cycle_no, CAST(position AS BIGINT) AS position, stem"


@query("graph_cycles", f"WITH RECURSIVE {_PARSED_SQL}, {_WALK_SQL} SELECT {_CYCLE_COLUMNS} FROM walk")
def graph_cycles(t: Tables) -> DataFrame:
    return components.cycles(graph.build_graph(_plans(t)).edges)


@query(
    "graph_reach_cycles",
    f"""WITH RECURSIVE {_PARSED_SQL}, {_WALK_SQL},
    found AS (SELECT max(scc) AS stem FROM component UNION SELECT dst FROM found JOIN edges ON src = found.stem)
    SELECT {_CYCLE_COLUMNS} FROM walk WHERE scc IN (SELECT stem FROM found)""",
)
def graph_reach_cycles(t: Tables) -> DataFrame:
    """The cycles in what the last of the cyclic components reaches."""
    whole = graph.build_graph(_plans(t))
    found = materialize(components.cycles(whole.edges), "cycles")
    return graph.contained_cycles(found, graph.reachable_subgraph(whole, found.agg(F.max("scc")).first()[0]))


@query(
    "graph_roots",
    f"""WITH RECURSIVE {_VISIBLE_SQL}, {_COMPONENT_SQL},
    shown AS (SELECT * FROM edges WHERE src IN (SELECT stem FROM visible) AND dst IN (SELECT stem FROM visible)),
    entered AS (
      SELECT d.scc FROM shown JOIN component d ON d.stem = dst LEFT JOIN component s ON s.stem = src
      WHERE s.scc IS DISTINCT FROM d.scc)
    SELECT stem FROM visible WHERE stem NOT IN (SELECT dst FROM shown)
    UNION ALL SELECT DISTINCT scc FROM component WHERE stem IN (SELECT stem FROM visible)
      AND scc NOT IN (SELECT scc FROM entered)""",
)
def graph_roots(t: Tables) -> DataFrame:
    whole = graph.build_graph(_plans(t))
    return graph.roots(whole, graph.visible(whole))
