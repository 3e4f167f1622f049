"""Queries that verify migrations, and vector neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import vectors, verify
from fleetscope.plans.registry import TABLE_NAMES, Tables, query, to_duckdb

_KEPT = {"orders": "o_orderstatus <> 'P'", "lineitem": "l_returnflag <> 'R'"}
_MOVED = [name for name in TABLE_NAMES if name != "pages"]

_SOURCE_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS source_rows FROM {n}" for n in TABLE_NAMES)
_TARGET_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS target_rows FROM {n} WHERE {_KEPT.get(n, 'true')}" for n in _MOVED
)


@query(
    "reconcile_counts",
    f"""SELECT table_name, source_rows, target_rows,
    CASE WHEN source_rows = target_rows THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM ({_SOURCE_SQL}) FULL JOIN ({_TARGET_SQL}) USING (table_name)""",
)
def reconcile_counts(t: Tables) -> DataFrame:
    source = verify.table_counts({name: t(name) for name in TABLE_NAMES})
    target = verify.table_counts({name: t(name).where(_KEPT.get(name, "true")) for name in _MOVED})
    return verify.reconcile_counts(source, target)


#: Revision chains told from parts, one database per fifty; some fork, some are stamped wrong or never.
REVISIONS = """
SELECT 'db' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS db, 'r' || CAST(p_partkey AS STRING) AS revision,
  CASE WHEN p_partkey % 50 = 0 THEN NULL
    WHEN p_partkey % 350 = 30 THEN 'r' || CAST(p_partkey - 2 AS STRING)
    ELSE 'r' || CAST(p_partkey - 1 AS STRING) END AS parent
FROM {part}
"""
STAMPED = """
SELECT db, CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 = 1 THEN 'r' || CAST(last - 1 AS STRING)
  ELSE 'r' || CAST(last AS STRING) END AS revision
FROM (SELECT 'db' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS db,
  max(CAST(floor(p_partkey / 50) AS BIGINT)) AS n, max(p_partkey) AS last FROM {part}
  GROUP BY 'db' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING))
"""

_HEADS_SQL = f"""
revs AS ({to_duckdb(REVISIONS)}),
heads AS (
  SELECT db, revision FROM revs r WHERE NOT EXISTS (SELECT 1 FROM revs c WHERE c.db = r.db AND c.parent = r.revision))
"""


@query("revision_heads", f"WITH {_HEADS_SQL} SELECT db, revision FROM heads")
def revision_heads(t: Tables) -> DataFrame:
    return verify.revision_heads(t.sql(REVISIONS))


@query(
    "revision_status",
    f"""WITH {_HEADS_SQL} SELECT s.db, h.n AS head_count,
    s.revision <> '' AND h.n = 1 AND s.revision = h.head AS healthy FROM ({to_duckdb(STAMPED)}) s
    JOIN (SELECT db, count(*) AS n, min(revision) AS head FROM heads GROUP BY db) h ON h.db = s.db""",
)
def revision_status(t: Tables) -> DataFrame:
    return verify.revision_status(t.sql(REVISIONS), t.sql(STAMPED))


EMAILS = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE lower(c_name) END || '@example.com' AS email
FROM {customer}
"""


@query("email_violations", f"SELECT c_custkey, email FROM ({to_duckdb(EMAILS)}) WHERE email <> lower(email)")
def email_violations(t: Tables) -> DataFrame:
    return verify.email_violations(t.sql(EMAILS))


@query(
    "vector_topk",
    """
    WITH long AS (
      SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    centre AS (SELECT label AS query_id, i, avg(x) AS y FROM long GROUP BY ALL),
    size AS (SELECT vec_id, sqrt(sum(x * x)) AS nx FROM long GROUP BY ALL),
    csize AS (SELECT query_id, sqrt(sum(y * y)) AS ny FROM centre GROUP BY ALL),
    dots AS (SELECT query_id, vec_id, sum(x * y) AS d FROM long JOIN centre USING (i) GROUP BY ALL)
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(d / nx / ny, 6) AS score
    FROM dots JOIN size USING (vec_id) JOIN csize USING (query_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d / nx / ny DESC, vec_id) <= 5
    """,
)
def vector_topk(t: Tables) -> DataFrame:
    """The five vectors nearest to the mean vector of each label."""
    found = vectors.nearest_neighbours(t("embeddings"), vectors.centroids(t("embeddings"), "label"), 5)
    return found.withColumn("score", F.round("score", 6))
