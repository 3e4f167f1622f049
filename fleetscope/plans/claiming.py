"""Queries over claims, tree operations and sign-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import keys
from fleetscope.operators import claims, identity
from fleetscope.plans.registry import EVENT_SCHEMA, Tables, query, to_duckdb
from fleetscope.sources.readers import attribute_map
from fleetscope.streaming import flows, stateful

#: Symbol claims told from parts; a third of them fall on one file.
CLAIMS = """
SELECT CASE WHEN p_partkey % 17 = 0 THEN 'worktree' ELSE 'symbol' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'repo0:src/Brand#0.rs' WHEN p_partkey % 19 = 0 THEN 'loose'
    ELSE 'repo' || CAST(p_size % 3 AS STRING) || ':src/' || p_brand || CASE WHEN p_size > 45 THEN '.rs2' ELSE '.rs' END
  END || CASE WHEN p_partkey % 19 = 0 AND p_partkey % 3 <> 0 THEN '' ELSE ':Type::m' || CAST(p_partkey AS STRING) END
    AS resource_key,
  CASE WHEN p_partkey % 13 <> 0 THEN 'm' || CAST(p_partkey % 20 AS STRING) END AS machine_id,
  CAST(p_size * 10 AS INT) AS ttl_seconds,
  timestamp_micros(1704067200000000 + p_partkey % 600 * 1000000) AS observed_at
FROM {part}
"""

FILES = """
SELECT 'repo' || CAST(s_nationkey % 3 AS STRING) AS repo,
  CASE WHEN s_suppkey % 9 = 4 THEN '  ' ELSE ' src/Brand#' || CAST(s_suppkey % 25 AS STRING) || '.rs ' END AS rel_file
FROM {supplier}
"""

_SCOPED_SQL = f"""
claims AS ({to_duckdb(CLAIMS)}),
files AS (SELECT DISTINCT repo, trim(rel_file) AS rel_file FROM ({to_duckdb(FILES)}) WHERE trim(rel_file) <> ''),
held AS (
  SELECT repo, rel_file AS file, list_extract(string_split(resource_key, ':'), -1) AS symbol, machine_id, ttl_seconds,
    resource_key
  FROM files JOIN claims ON kind = 'symbol' AND starts_with(resource_key, repo || ':' || rel_file || ':'))
"""


def _files(t: Tables) -> DataFrame:
    """Both lists of the scope; here every file is in both."""
    return claims.scope_files(t.sql(FILES), t.sql(FILES))


def _conflicts(t: Tables) -> DataFrame:
    local = keys.local_identity(F.lit(""), F.lit("m7"))  # a machine without a device id
    return claims.exclude_self(claims.claims_on_files(_files(t), t.sql(CLAIMS)), local)


@query("scope_files", f"WITH {_SCOPED_SQL} SELECT repo, rel_file FROM files")
def scope_files(t: Tables) -> DataFrame:
    return _files(t)


@query("claim_conflicts", f"WITH {_SCOPED_SQL} SELECT * FROM held WHERE machine_id IS DISTINCT FROM 'm7'")
def claim_conflicts(t: Tables) -> DataFrame:
    return _conflicts(t)


@query(
    "conflict_summary",
    f"""WITH {_SCOPED_SQL},
    conflicts AS (SELECT * FROM held WHERE machine_id IS DISTINCT FROM 'm7'),
    errors AS (SELECT repo, rel_file AS file FROM files WHERE rel_file LIKE '%3.rs')
    SELECT coalesce(c.repo, e.repo) AS repo, coalesce(c.file, e.file) AS file, coalesce(n, 0) AS conflicts,
      coalesce(machines, 0) AS machines, coalesce(failed, 0) AS errors, coalesce(n, 0) > 0 AS has_conflict
    FROM (SELECT repo, file, count(*) AS n, count(DISTINCT machine_id) AS machines FROM conflicts GROUP BY ALL) c
    FULL JOIN (SELECT repo, file, count(*) AS failed FROM errors GROUP BY ALL) e
      ON c.repo = e.repo AND c.file = e.file""",
)
def conflict_summary(t: Tables) -> DataFrame:
    failed = _files(t).where("rel_file LIKE '%3.rs'").select("repo", F.col("rel_file").alias("file"))
    return claims.conflict_summary(_conflicts(t), failed)


@query(
    "live_claims",
    f"""SELECT resource_key, machine_id, ttl_seconds FROM ({to_duckdb(CLAIMS)})
    WHERE epoch_us(observed_at) + ttl_seconds * 1000000 > epoch_us(TIMESTAMP '2024-01-01 00:08:20')""",
)
def live_claims(t: Tables) -> DataFrame:
    live = claims.live_claims(t.sql(CLAIMS), F.lit("2024-01-01 00:08:20").cast("timestamp"))
    return live.select("resource_key", "machine_id", "ttl_seconds")


#: Claims told from events: a machine observes a symbol again and again, and each observation lives for a while.
OBSERVED = """
SELECT 'repo' || CAST(user_id % 3 AS STRING) || ':src/' || event_type || '.rs:Type::m' || CAST(user_id % 40 AS STRING)
    AS resource_key, 'm' || CAST(event_id % 5 AS STRING) AS machine_id, ts AS observed_at,
  CAST(300 + event_id % 9 * 400 AS INT) AS ttl_seconds
FROM {events}
"""


@query(
    "stream_live_claims",
    f"""WITH seen AS (
      SELECT *, observed_at + INTERVAL 1 SECOND * ttl_seconds AS ends FROM ({to_duckdb(OBSERVED)})),
    looked AS (
      SELECT *, max(ends) OVER (PARTITION BY resource_key, machine_id ORDER BY observed_at, ends
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seen),
    spans AS (
      SELECT *, count(*) FILTER (before IS NULL OR observed_at >= before) OVER (
        PARTITION BY resource_key, machine_id ORDER BY observed_at, ends ROWS UNBOUNDED PRECEDING) AS span FROM looked)
    SELECT resource_key, machine_id, unnest(['claimed', 'expired']) AS change, unnest([min(observed_at), max(ends)]) AS at
    FROM spans GROUP BY resource_key, machine_id, span""",
)
def stream_live_claims(t: Tables) -> DataFrame:
    """When each claim begins and ends to be live."""
    seen = t.spark.sql(OBSERVED, events=t.stream_to_the_end("events", EVENT_SCHEMA))
    return flows.run_available(stateful.live_claims_stream(seen, "1 hour", bucket_s=3600), "live-claims")


@query(
    "dedup_in_order",
    """SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def dedup_in_order(t: Tables) -> DataFrame:
    seen = t("events").select("user_id", "event_type", "event_id", "ts")
    return claims.dedup_in_order(seen, ["user_id", "event_type"], "ts", "event_id").drop("ts")


#: Tree operations told from events, and tree claims from customers and suppliers.
CALLS = """
SELECT event_id AS call_id, CASE event_id % 3
    WHEN 0 THEN '/d/Trees/C' || CAST(user_id AS STRING) || '/'
    WHEN 1 THEN 'D:' || chr(92) || 'trees' || chr(92) || 'c' || CAST(user_id AS STRING)
    ELSE 'd:/trees/c' || CAST(user_id AS STRING) END AS path,
  CASE WHEN event_id % 37 <> 0 THEN 'm' || CAST(event_id % 3 AS STRING) END AS machine_id,
  CASE WHEN event_id % 4 <> 0 THEN 's' || CAST(event_id % 4 AS STRING) END AS session_id,
  event_id % 29 = 0 AS skip, event_type = 'purchase' AS enforce, event_id % 31 <> 0 AS tool_present,
  event_id % 23 <> 0 AS in_tree, event_id % 19 <> 0 AS lookup_ok
FROM {events}
"""

TREE_CLAIMS = """
SELECT 'worktree' AS kind, 'd:/trees/c' || CAST(c_custkey AS STRING) AS resource_key,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'm' || CAST(c_custkey % 3 AS STRING) END AS machine_id,
  CASE WHEN c_custkey % 2 = 0 THEN 's' || CAST(c_custkey % 4 AS STRING) END AS session_id,
  timestamp_micros(1704067200000000) AS observed_at, CASE WHEN c_custkey % 7 = 0 THEN 600 ELSE 86400 END AS ttl_seconds
FROM {customer} WHERE c_nationkey <> 7
UNION ALL
SELECT 'worktree', 'd:/trees/c' || CAST(s_suppkey * 2 AS STRING), 'm1', 's1', timestamp_micros(1704067260000000),
  CASE WHEN s_suppkey % 3 = 0 THEN 540 ELSE 541 END
FROM {supplier}
"""
#: The moment claims are looked up, in microseconds: some have just run out.
LOOKUP_US = 1704067800000000

_GUARD_SQL = f"""
calls AS ({to_duckdb(CALLS)}),
newest AS (
  SELECT * FROM ({to_duckdb(TREE_CLAIMS)}) WHERE epoch_us(observed_at) + CAST(ttl_seconds AS BIGINT) * 1000000 > {LOOKUP_US}
  QUALIFY row_number() OVER (
    PARTITION BY resource_key ORDER BY observed_at DESC, machine_id DESC, session_id DESC NULLS LAST) = 1),
looked AS (
  SELECT c.*, n.resource_key AS found, n.machine_id AS holder, n.session_id AS holder_session FROM calls c
  LEFT JOIN newest n ON n.resource_key =
    lower(regexp_replace(replace(regexp_replace(path, '^/([a-zA-Z])/', '\\1:/'), chr(92), '/'), '/$', ''))),
reasoned AS (
  SELECT call_id, enforce, CASE WHEN skip THEN 'skip' WHEN NOT tool_present THEN 'no-tool'
    WHEN NOT in_tree THEN 'not-a-tree' WHEN machine_id IS NULL THEN 'no-identity'
    WHEN NOT lookup_ok THEN 'lookup-failed' WHEN found IS NULL THEN 'no claim held'
    WHEN holder = '' THEN 'no-holder-field' WHEN holder <> machine_id THEN 'held by another machine'
    WHEN holder_session IS NULL OR holder_session = session_id THEN 'held-by-us'
    ELSE 'held by another session' END AS reason FROM looked),
decided AS (
  SELECT call_id, reason, CASE WHEN reason NOT IN ('no claim held', 'held by another machine',
    'held by another session') THEN 'ALLOW' WHEN enforce THEN 'BLOCK' ELSE 'WARN' END AS decision FROM reasoned)
"""


def _decided(t: Tables) -> DataFrame:
    return claims.guard_decision(
        claims.lookup_tree_claim(t.sql(CALLS), t.sql(TREE_CLAIMS), F.timestamp_micros(F.lit(LOOKUP_US)))
    )


@query("tree_guard", f"WITH {_GUARD_SQL} SELECT call_id, decision, reason FROM decided")
def tree_guard(t: Tables) -> DataFrame:
    return _decided(t).select("call_id", "decision", "reason")


@query("guard_decision_counts", f"WITH {_GUARD_SQL} SELECT decision, reason, count(*) AS fires FROM decided GROUP BY ALL")
def guard_decision_counts(t: Tables) -> DataFrame:
    """Counted from breadcrumb lines written for every decision."""
    reason = F.concat(F.lit('"'), F.col("reason"), F.lit('"'))
    line = F.concat(F.lit("2024-01-01T00:00:00+0000 pid=1 "), F.col("decision"), F.lit(" reason="), reason)
    return claims.guard_decision_counts(_decided(t).select(line.alias("message")))


#: Sign-ups told from events, accounts and the invitation list from customers.
SIGNUPS = """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Google_' WHEN 1 THEN 'MicrosoftEntra_' WHEN 2 THEN 'GitHub_' ELSE 'plain'
    END || CAST(user_id AS STRING) || '_x' AS user_name,
  CASE event_type WHEN 'view' THEN 'PreSignUp_AdminCreateUser' WHEN 'click' THEN 'PreSignUp_SignUp'
    ELSE 'PreSignUp_ExternalProvider' END AS trigger_source,
  CASE WHEN event_id % 41 <> 0 THEN 'user' || CAST(user_id AS STRING) || '@example.com' END AS email,
  CASE event_id % 9 WHEN 0 THEN 'false' WHEN 1 THEN 'True' ELSE 'true' END AS email_verified
FROM {events}
"""

ACCOUNTS = """
SELECT c_name AS Username, CASE WHEN c_custkey % 7 = 0 THEN 'UNCONFIRMED' ELSE 'CONFIRMED' END AS UserStatus,
  'user' || CAST(c_custkey % 400 AS STRING) || '@example.com' AS email,
  CASE WHEN c_custkey % 5 = 0 THEN 'false' ELSE 'true' END AS verified,
  CASE WHEN c_custkey % 3 = 0 THEN 'linked' ELSE '' END AS identities
FROM {customer}
"""

INVITED = """
SELECT ' USER' || CAST(c_custkey % 400 AS STRING) || '@Example.com ' AS email FROM {customer} WHERE c_nationkey < 20
UNION ALL SELECT ' ' FROM {region}
"""

_MATCH_SQL = f"""
native AS (
  SELECT email, count(*) AS n, min(Username) AS destination_user FROM ({to_duckdb(ACCOUNTS)})
  WHERE UserStatus = 'CONFIRMED' AND verified = 'true' AND identities = '' GROUP BY email)
"""


def _directory(t: Tables) -> DataFrame:
    """Accounts with attribute lists; the repeated name checks that the last value wins."""
    pair = lambda name, value: F.struct(F.lit(name).alias("Name"), value.alias("Value"))
    pairs = F.array(
        pair("email", F.lit("first@example.com")),
        pair("email_verified", F.col("verified")),
        pair("identities", F.col("identities")),
        pair("email", F.col("email")),
    )
    return t.sql(ACCOUNTS).select("Username", "UserStatus", attribute_map(pairs).alias("attributes"))


@query("unique_native_match", f"WITH {_MATCH_SQL} SELECT email, destination_user FROM native WHERE n = 1")
def unique_native_match(t: Tables) -> DataFrame:
    return identity.unique_native_match(_directory(t))


@query(
    "signup_decision",
    f"""WITH {_MATCH_SQL},
    allow AS (SELECT DISTINCT lower(trim(email)) AS email FROM ({to_duckdb(INVITED)}) WHERE trim(email) <> ''),
    acted AS (
      SELECT s.*, d.destination_user AS target, CASE
        WHEN trigger_source <> 'PreSignUp_AdminCreateUser' AND a.email IS NULL THEN 'blocked'
        WHEN trigger_source <> 'PreSignUp_ExternalProvider' THEN 'untouched'
        WHEN email_verified <> 'true' OR s.email IS NULL THEN 'skip_unverified'
        WHEN NOT (starts_with(user_name, 'Google_') OR starts_with(user_name, 'MicrosoftEntra_')) THEN 'skip_untrusted'
        WHEN d.email IS NULL THEN 'skip_no_unique_match' ELSE 'link' END AS action
      FROM ({to_duckdb(SIGNUPS)}) s LEFT JOIN allow a ON a.email = lower(trim(coalesce(s.email, '')))
      LEFT JOIN native d ON d.email = s.email AND d.n = 1)
    SELECT event_id, action, CASE WHEN action = 'link' THEN target END AS destination_user,
      CASE WHEN action = 'link' THEN string_split(user_name, '_')[1] END AS provider,
      CASE WHEN action = 'link' THEN substr(user_name, instr(user_name, '_') + 1) END AS subject,
      action = 'link' AS auto_confirm, action = 'link' AS auto_verify FROM acted""",
)
def signup_decision(t: Tables) -> DataFrame:
    out = identity.signup_decisions(t.sql(SIGNUPS), _directory(t), t.sql(INVITED))
    return out.drop("user_name", "trigger_source", "email", "email_verified")
