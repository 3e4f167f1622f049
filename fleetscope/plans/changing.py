"""Queries over change documents.

Each line item tells one change as a JSON document; its order is the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import changes
from fleetscope.plans.registry import Tables, query, to_duckdb
from fleetscope.sources.readers import explode_changes, read_changes

_FACTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d,
  CASE l_partkey % 10 WHEN 0 THEN 'aws_db_instance' WHEN 1 THEN 'aws_ecs_service' WHEN 2 THEN 'aws_lambda_function'
    WHEN 3 THEN 'aws_iam_role_policy' WHEN 4 THEN 'aws_security_group_rule' WHEN 5 THEN 'aws_ecs_task_definition'
    WHEN 6 THEN 'aws_route53_record' WHEN 7 THEN 'aws_cloudwatch_log_group' WHEN 8 THEN 'aws_db_instance' END AS kind,
  l_partkey % 89 < 3 AS broken, CASE l_suppkey % 10 WHEN 3 THEN '7' WHEN 4 THEN '"create"' WHEN 5 THEN '"delete"' WHEN 6 THEN '"delete","create"'
    WHEN 7 THEN '"no-op"' WHEN 8 THEN '"read"' WHEN 9 THEN '"forget"' ELSE '"update"' END AS actions
FROM {lineitem}
"""

CHANGE_DOCS = (
    """
SELECT CAST(l_orderkey AS STRING) AS run_id,
  CASE l_partkey % 89 WHEN 0 THEN 'terraform crashed' WHEN 1 THEN '{{"resource_changes":[{{"address":"r' WHEN 2 THEN
  '{{"resource_changes":{{"a":1}}}}' ELSE
  '{{"resource_changes":[{{"address":"r.' || CAST(l_partkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '"' ||
  CASE WHEN kind IS NULL THEN '' ELSE ',"type":"' || kind || '"' END ||
  ',"change":{{"actions":' || CASE WHEN actions = '7' THEN '"update"' ELSE '[' || actions || ']' END || ',"before":{{"allocated_storage":' || CAST(q AS STRING) ||
  ',"instance_class":"c' || CAST(q % 4 AS STRING) || '","container_definitions":"v' || CAST(d AS STRING) ||
  '","environment":null,"policy":{{"b":1,"a":[2]}}}},"after":{{"allocated_storage":' || CAST(q + d % 2 AS STRING) ||
  ',"instance_class":"c' || CAST((q + l_suppkey % 2) % 4 AS STRING) || '","container_definitions":"v' ||
  CAST(d + q % 2 AS STRING) || '","policy":{{"a":[' || CAST(2 + l_linenumber % 2 AS STRING) ||
  '],"b":1}}}},"after_unknown":{{"id":' || CASE WHEN d = 3 THEN 'true' ELSE 'false' END ||
  ',"environment":' || CASE WHEN d = 5 THEN '{{"x":true}}' ELSE '{{}}' END || '}}}}}}]}}' END AS doc
FROM ("""
    + _FACTS
    + ")"
)

_PAIRS = ", ".join(f"'{kind}|{name}'" for kind, name in fv.NEGATING)
_RANK = " ".join(f"WHEN '{kind}|{name}' THEN {rank}" for rank, (kind, name) in enumerate(fv.NEGATING_PRIORITY))
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)

_RECORDS_SQL = f"""
facts AS ({to_duckdb(_FACTS)}),
named AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS run_id, broken, coalesce(kind, 'unknown') AS kind,
    'r.' || CAST(l_partkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS resource,
    string_split(replace(actions, '"', ''), ',') AS actions,
    list_filter([CASE WHEN d % 2 = 1 THEN 'allocated_storage' END, CASE WHEN q % 2 = 1 THEN 'container_definitions' END,
      CASE WHEN d = 5 THEN 'environment' END, CASE WHEN d = 3 THEN 'id' END,
      CASE WHEN l_suppkey % 2 = 1 THEN 'instance_class' END, CASE WHEN l_linenumber % 2 = 1 THEN 'policy' END],
      lambda x: x IS NOT NULL) AS attrs FROM facts),
hit AS (
  SELECT *, list_filter(attrs, lambda x: kind || '|' || x IN ({_PAIRS})) AS hits,
    list_filter(actions, lambda x: x <> 'no-op') AS acts FROM named),
judged AS (
  SELECT *, CASE WHEN len(acts) = 0 OR actions = ['read'] THEN 'ok'
      WHEN list_contains(acts, 'delete') THEN
        CASE WHEN kind IN ({_LIST(fv.SERVING_TYPES)}) THEN 'active_negation' ELSE 'in_place_change' END
      WHEN acts = ['create'] THEN
        CASE WHEN kind IN ({_LIST(fv.SENSITIVE_CREATE_TYPES)}) THEN 'in_place_change' ELSE 'benign_add' END
      WHEN list_contains(acts, 'update') THEN
        CASE WHEN len(hits) > 0 THEN 'active_negation' ELSE 'in_place_change' END
      ELSE 'unknown' END AS classification,
    CASE WHEN list_contains(acts, 'update') THEN CASE WHEN len(hits) > 0 THEN
        list_sort(list_transform(hits, lambda x: {{'r': CASE kind || '|' || x {_RANK} ELSE 99 END, 'x': x}}))[1].x
      ELSE attrs[1] END END AS attribute,
    NOT (kind = 'aws_ecs_task_definition' AND attrs = ['container_definitions']) AS terraform_owned
  FROM hit),
records AS (SELECT * FROM judged WHERE classification <> 'ok' AND NOT broken)
"""


def _docs(t: Tables) -> DataFrame:
    return t.sql(CHANGE_DOCS, heavy=True)


def _coverage(t: Tables) -> DataFrame:
    """One row per order, which is a run."""
    full = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    return t("orders").select(F.col("o_orderkey").cast("string").alias("run_id"), full.alias("coverage"))


def _records(t: Tables) -> DataFrame:
    return changes.classify_changes(explode_changes(_docs(t))[0])


@query(
    "change_classify",
    f"WITH {_RECORDS_SQL} SELECT run_id, resource, kind, attribute, classification, terraform_owned FROM records",
)
def change_classify(t: Tables) -> DataFrame:
    return _records(t).drop("_reason")


_WORST = "CASE WHEN bool_or(broken) THEN 'error' ELSE CASE max(CASE classification {} END) {} ELSE 'ok' END END".format(
    " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in fv.SEVERITY.items()),
    " ".join(f"WHEN {rank} THEN '{name}'" for name, rank in fv.SEVERITY.items()),
)


@query(
    "worst_change_per_run",
    f"WITH {_RECORDS_SQL} SELECT run_id, {_WORST} AS worst FROM judged GROUP BY run_id",
)
def worst_change_per_run(t: Tables) -> DataFrame:
    return changes.worst_per_run(read_changes(_docs(t)))


@query(
    "change_errors",
    f"WITH {_RECORDS_SQL} SELECT run_id, 'unreadable document' AS error, count(*) AS documents FROM named WHERE broken GROUP BY run_id",
)
def change_errors(t: Tables) -> DataFrame:
    errors = explode_changes(_docs(t))[1]
    return errors.groupBy("run_id", "error").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "drift_summary",
    f"""WITH {_RECORDS_SQL} SELECT run_id, classification, terraform_owned, count(*) AS records,
    CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS coverage
    FROM records GROUP BY ALL""",
)
def drift_summary(t: Tables) -> DataFrame:
    return changes.drift_summary(_records(t), _coverage(t))


@query(
    "drift_batches",
    f"""WITH {_RECORDS_SQL}, one AS (SELECT CAST(CAST(run_id AS BIGINT) % 5 AS VARCHAR) AS run_id, resource, kind,
      attribute, classification, terraform_owned, run_id AS origin FROM records)
    SELECT run_id, resource, origin, (row_number() OVER (PARTITION BY run_id ORDER BY resource, kind,
      attribute NULLS FIRST, classification, terraform_owned, origin) - 1) // 500 AS batch_id FROM one""",
)
def drift_batches(t: Tables) -> DataFrame:
    """Batches of 500 over five merged runs, so that runs need several batches."""
    merged = _records(t).withColumn("origin", F.col("run_id")).withColumn("run_id", (F.col("run_id").cast("bigint") % 5).cast("string"))
    return changes.scrub_payload(merged, _coverage(t), batch_rows=500).select("run_id", "resource", "origin", "batch_id")
