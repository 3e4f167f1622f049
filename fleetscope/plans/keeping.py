"""Queries of retention, quotas, object inventories and cache counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import cache, retention
from fleetscope.plans.registry import Tables, query, to_duckdb
from fleetscope.session import scratch_path
from fleetscope.sources import cold_store
from fleetscope.sources.readers import bucket_root, with_object_owner
from fleetscope.streaming import flows, stateful

#: Session chunks told from conversations: one turn is one chunk.
CHUNKS = """
SELECT CAST(conv_id % 7 AS STRING) AS tenant_id, CAST(conv_id AS STRING) AS session_id, turn AS seq, text,
  CAST(octet_length(text) AS BIGINT) AS size,
  timestamp_micros(1704067200000000 + (conv_id * 37 % 101) * 3600000000 + turn * 60000000) AS ts
FROM {conversations}
"""


@query(
    "fifo_keep",
    f"""SELECT session_id, seq, size, bytes_so_far, bytes_so_far <= 2000 AS kept FROM (
      SELECT *, CAST(sum(size) OVER (PARTITION BY session_id ORDER BY seq DESC) AS BIGINT) AS bytes_so_far
      FROM ({to_duckdb(CHUNKS)}))""",
)
def fifo_keep(t: Tables) -> DataFrame:
    return retention.fifo_keep(t.sql(CHUNKS), 2000).select("session_id", "seq", "size", "bytes_so_far", "kept")


_TENANT_SQL = f"""
SELECT tenant_id, session_id, seq, CASE WHEN sum(size) OVER (PARTITION BY tenant_id ORDER BY ts {{0}}, session_id {{0}},
  seq {{0}}) <= {{1}} THEN 'keep' ELSE '{{2}}' END AS action FROM ({to_duckdb(CHUNKS)})
"""


@query("tenant_quota_evict", _TENANT_SQL.format("DESC", 20000, "evict"))
def tenant_quota_evict(t: Tables) -> DataFrame:
    out = retention.tenant_fifo_keep(t.sql(CHUNKS), 20000)
    return out.select("tenant_id", "session_id", "seq", "action")


@query("tenant_quota_refuse", _TENANT_SQL.format("ASC", 25000, "refuse"))
def tenant_quota_refuse(t: Tables) -> DataFrame:
    out = retention.tenant_fifo_keep(t.sql(CHUNKS), 25000, over_quota="refuse")
    return out.select("tenant_id", "session_id", "seq", "action")


_PARTS_SQL = f"""
SELECT *, CAST((sum(size) OVER (PARTITION BY session_id ORDER BY seq) - size) // 1500 AS BIGINT) AS part_no
FROM ({to_duckdb(CHUNKS)})
"""


def _cold_store(t: Tables) -> str:
    """All sessions, closed with their last turn, written to a new store."""
    chunks = t.sql(CHUNKS).withColumns({"bytes": F.col("text").cast("binary"), "closed_at": F.col("ts")}).drop("text")
    path = scratch_path(t.spark, "cold-store")
    cold_store.write(chunks, path, part_bytes=1500)
    return path


@query(
    "cold_manifest",
    f"""SELECT tenant_id, session_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS size_bytes,
    count(DISTINCT part_no) AS parts, 'tenant/' || tenant_id || '/session/' || session_id || '.log' AS object_key
    FROM ({_PARTS_SQL}) GROUP BY tenant_id, session_id""",
)
def cold_manifest(t: Tables) -> DataFrame:
    return cold_store.read_manifest(t.spark, _cold_store(t))


@query(
    "cold_objects",
    f"""SELECT session_id, part_no, md5(string_agg(text, '' ORDER BY seq)) AS body_md5,
      CAST(sum(size) AS BIGINT) AS body_bytes FROM ({_PARTS_SQL}) GROUP BY session_id, part_no""",
)
def cold_objects(t: Tables) -> DataFrame:
    parts = cold_store.read_objects(t.spark, _cold_store(t))
    size = F.octet_length("body").cast("bigint").alias("body_bytes")
    return parts.select("session_id", "part_no", F.md5("body").alias("body_md5"), size)


@query(
    "stream_hot_tail",
    f"""SELECT session_id, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS bytes_kept,
      md5(string_agg(text, '' ORDER BY seq)) AS tail_md5 FROM (
      SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY seq DESC) AS so_far FROM ({to_duckdb(CHUNKS)})
      WHERE CAST(session_id AS BIGINT) % 9 <> 8) WHERE so_far <= 3000 GROUP BY session_id""",
)
def stream_hot_tail(t: Tables) -> DataFrame:
    """The tail of every session still open; one in nine closes with its last turn."""
    turns = t.stream("conversations", "conv_id long, turn long, role string, text string")
    chunks = turns.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("seq"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").cast("binary").alias("body"),
        (F.col("conv_id") % 9 == 8).alias("closed"),
    )
    out = flows.run_available(stateful.hot_tail(chunks, 3000), "hot-tail")
    return out.withColumn("tail_md5", F.md5("tail")).drop("tail")


#: An object inventory told from events.
INVENTORY = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'warm' WHEN 'click' THEN 'cold' WHEN 'purchase' THEN 'blob'
    WHEN 'signup' THEN 'cache' ELSE 'logs' END AS store,
  CASE event_type WHEN 'view' THEN 'w/' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'screenshots/' ELSE 'other/' END
    WHEN 'click' THEN CASE WHEN user_id % 4 = 0 THEN 'parked/' ELSE 'tenant/t' || CAST(user_id % 6 AS STRING) ||
      '/session/' END ELSE 'k/' END || CAST(event_id AS STRING) || '.log' AS key,
  event_id % 5 = 0 AS incomplete, ts AS created, event_id * 13 % 1009 AS size,
  CASE WHEN event_type = 'view' AND user_id % 3 <> 0 THEN ts END AS closed_at
FROM {events}
"""

_AS_OF = "2024-04-08 12:00:00"


@query(
    "lifecycle_expiry",
    f"""WITH ruled AS (SELECT *, CASE
        WHEN store = 'warm' AND NOT incomplete THEN 7
        WHEN store = 'cold' AND incomplete THEN 7 WHEN store = 'cold' AND starts_with(key, 'tenant/') THEN 90
        WHEN store = 'blob' AND incomplete THEN 7 WHEN store = 'blob' AND starts_with(key, 'screenshots/') THEN 90
        WHEN store = 'cache' THEN CASE WHEN incomplete THEN 1 ELSE 30 END
        WHEN store = 'logs' AND NOT incomplete THEN 14 END AS ttl_days FROM ({to_duckdb(INVENTORY)}))
    SELECT event_id, store, key, CAST(ttl_days AS INTEGER) AS ttl_days,
      coalesce(CASE WHEN store = 'warm' THEN closed_at ELSE created END
        < TIMESTAMP '{_AS_OF}' - to_days(CAST(ttl_days AS INTEGER)), false) AS expired FROM ruled""",
)
def lifecycle_expiry(t: Tables) -> DataFrame:
    out = retention.expire(t.sql(INVENTORY), F.lit(_AS_OF).cast("timestamp"))
    return out.select("event_id", "store", "key", "ttl_days", "expired")


@query(
    "tenant_usage",
    f"""SELECT tenant_id, count(*) AS objects, CAST(sum(size) AS BIGINT) AS size_bytes FROM (
      SELECT size, regexp_extract(key, '^tenant/([^/]+)/session/([^/]+)\\.log$', 1) AS tenant_id
      FROM ({to_duckdb(INVENTORY)})) WHERE tenant_id <> '' GROUP BY tenant_id""",
)
def tenant_usage(t: Tables) -> DataFrame:
    return retention.tenant_usage(with_object_owner(t.sql(INVENTORY)))


@query(
    "bucket_usage",
    f"""SELECT store, count(*) AS objects, CAST(sum(size) AS BIGINT) AS size_bytes FROM ({to_duckdb(INVENTORY)})
    GROUP BY store""",
)
def bucket_usage(t: Tables) -> DataFrame:
    return retention.usage(t.sql(INVENTORY), "store")


#: Image tags told from orders; what is live, from orders in progress.
TAGS = """
SELECT o_custkey AS image, CAST(o_orderkey AS STRING) AS tag, CAST(floor(o_orderkey / 4) AS BIGINT) AS image_id,
  o_orderdate AS created
FROM {orders}
"""
LIVE = "SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS image_id FROM {orders} WHERE o_orderstatus = 'P'"

_RANKED_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY image ORDER BY created DESC, tag DESC) AS rn FROM ({to_duckdb(TAGS)})
"""


@query("keep_latest_two", f"SELECT image, tag, created FROM ({_RANKED_SQL}) WHERE rn <= 2")
def keep_latest_two(t: Tables) -> DataFrame:
    return retention.keep_latest(t.sql(TAGS)).select("image", "tag", "created")


@query(
    "deletable_tags",
    f"""SELECT image, tag, created FROM ({_RANKED_SQL})
    WHERE rn > 2 AND image_id NOT IN (SELECT image_id FROM ({to_duckdb(LIVE)}))""",
)
def deletable_tags(t: Tables) -> DataFrame:
    return retention.deletable_tags(t.sql(TAGS), t.sql(LIVE)).select("image", "tag", "created")


#: Counter documents told from events: nested or flat, with text where numbers belong.
COUNTER_DOCS = """
SELECT 'host' || CAST(user_id AS STRING) AS owner, CASE WHEN user_id % 2 = 0 THEN '{{"stats":' ELSE '' END ||
  '{{"compile_requests":' || CAST(event_id % 50 AS STRING) || ',"cache_writes":"' || CAST(event_id AS STRING) ||
  '","cache_hits":{{"counts":{{"rust":' || CAST(event_id % 30 AS STRING) || ',"c":' || CAST(user_id % 5 AS STRING) ||
  ',"note":"9"}}}},"cache_misses":{{"counts":{{"rust":' || CAST(event_id % 7 AS STRING) || '}}}},"cache_errors":3}}' ||
  CASE WHEN user_id % 2 = 0 THEN '}}' ELSE '' END AS doc
FROM {events}
"""

_COUNTS_SQL = """
counts AS (
  SELECT 'host' || CAST(user_id AS VARCHAR) AS owner, CAST(sum(event_id % 50) AS BIGINT) AS requests,
    CAST(sum(event_id % 30 + user_id % 5) AS BIGINT) AS hits, CAST(sum(event_id % 7) AS BIGINT) AS misses
  FROM events GROUP BY ALL)
"""


def _counters(t: Tables) -> DataFrame:
    docs = t.sql(COUNTER_DOCS, heavy=True).select("owner", F.try_parse_json("doc").alias("doc"))
    return cache.flatten_counters(docs)


@query(
    "counter_totals",
    f"""WITH {_COUNTS_SQL} SELECT owner, requests AS compile_requests, CAST(NULL AS BIGINT) AS cache_writes,
    hits AS cache_hits, misses AS cache_misses, CAST(NULL AS BIGINT) AS cache_errors FROM counts""",
)
def counter_totals(t: Tables) -> DataFrame:
    names = ["compile_requests", "cache_writes", "cache_hits", "cache_misses", "cache_errors"]
    return _counters(t).groupBy("owner").agg(*[F.sum(name).alias(name) for name in names])


@query(
    "cache_hit_rate",
    f"""WITH {_COUNTS_SQL} SELECT owner, hits, misses, round(hits / (hits + misses), 9) AS hit_rate,
    hits / (hits + misses) >= 0.8 AS passes FROM counts""",
)
def cache_hit_rate(t: Tables) -> DataFrame:
    return cache.hit_rate(_counters(t), "owner").withColumn("hit_rate", F.round("hit_rate", 9))


@query(
    "exposition_rows",
    f"""WITH {_COUNTS_SQL},
    buckets AS (SELECT source AS owner, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY ALL),
    counted AS (
      SELECT owner, unnest([100, 180, 190]) AS rank, unnest(['compile_requests', 'cache_hits', 'cache_misses']) AS name,
        unnest([requests, hits, misses]) AS v FROM counts),
    gauges AS (
      SELECT owner, unnest([0, 10]) AS rank, unnest(['objects', 'size_bytes']) AS name,
        unnest(['Object count in', 'Total byte size of']) AS help, unnest([n, total]) AS v FROM buckets)
    SELECT owner, CAST(rank AS INTEGER) AS line_no, '# HELP sccache_bucket_' || name || ' ' || help ||
      ' the shared sccache MinIO bucket.' AS line FROM gauges
    UNION ALL SELECT owner, rank + 1, '# TYPE sccache_bucket_' || name || ' gauge' FROM gauges
    UNION ALL SELECT owner, rank + 2, 'sccache_bucket_' || name || '{{bucket="' || owner || '"}} ' || v FROM gauges
    UNION ALL SELECT owner, rank, '# TYPE sccache_local_' || name || '_total counter' FROM counted
    UNION ALL SELECT owner, rank + 1, 'sccache_local_' || name || '_total ' || v FROM counted""",
)
def exposition_rows(t: Tables) -> DataFrame:
    names = [*fv.SCALAR_COUNTERS, *fv.MAP_COUNTERS]
    counters = _counters(t).groupBy("owner").agg(*[F.sum(name).alias(name) for name in names])
    buckets = t("documents").groupBy(F.col("source").alias("owner")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("n_chars").alias("size_bytes")
    )
    return cache.exposition_rows(counters, buckets.withColumn("bucket", F.col("owner")))


#: Disk-usage listings told from events: two JSON lines, a blank one, or nothing.
LISTINGS = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 7 THEN '{{"objects":1}}' || chr(10) || '{{"objects":3'
  ELSE '{{"objects":1,"size":1}}' || chr(10) || '{{"objects":' ||
  CAST(event_id % 90 AS STRING) || ',"size":' || CAST(event_id * 7 AS STRING) || '}}' || chr(10) || chr(10) END AS listing
FROM {events}
"""


@query(
    "bucket_root",
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 0 WHEN 7 THEN NULL ELSE event_id % 90 END AS objects,
    CASE event_id % 10 WHEN 0 THEN 0 WHEN 7 THEN NULL ELSE event_id * 7 END AS size_bytes FROM events""",
)
def bucket_root_query(t: Tables) -> DataFrame:
    return t.sql(LISTINGS, heavy=True).select("event_id", bucket_root(F.col("listing")).alias("_r")).select("event_id", "_r.*")
