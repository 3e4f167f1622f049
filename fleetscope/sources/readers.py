"""Readers. Each returns a DataFrame with an explicit schema; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import keys

CHANGE_SCHEMA = (
    "resource_changes ARRAY<STRUCT<address STRING, type STRING, change STRUCT<actions ARRAY<STRING>, "
    "before MAP<STRING,VARIANT>, after MAP<STRING,VARIANT>, after_unknown MAP<STRING,VARIANT>>>>, _bad STRING"
)
#: The action of a change whose actions cannot be read; no rule knows it, so it is never taken for clean.
UNREADABLE = "unreadable"
LOG_SCHEMA = "log_group STRING, ts TIMESTAMP, message STRING"
METRIC_SCHEMA = "namespace STRING, metric STRING, dims MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"


def _file_stem(path_column):
    name = F.element_at(F.split(path_column, "/"), -1)
    return F.url_decode(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\+", "%2B"))


def _plan_folder(spark: SparkSession, folder: str, rank: int) -> DataFrame:
    text = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    location = F.col("_metadata.file_path")
    top = re.escape(folder.split("://")[-1].rstrip("/"))
    return text.where(F.url_decode(F.regexp_replace(location, r"\+", "%2B")).rlike(top + r"/[^/]+\.md$")).select(
        _file_stem(location).alias("stem"),
        F.col("value").alias("text"),
        location.alias("location"),
        F.lit(rank).alias("source_rank"),
    )


def scan_plan_docs(spark: SparkSession, active: str, archive: str | None = None) -> DataFrame:
    """Status documents of a folder, and of the archive where one is given.

    A missing active folder is an error; a missing archive is skipped.
    """
    docs = _plan_folder(spark, active, 0)
    if archive is None:
        return docs
    try:
        return docs.unionByName(_plan_folder(spark, archive, 1))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return docs


def _parsed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(run_id, _odd, _list of each document, why it cannot be read)."""
    read = F.from_json("doc", CHANGE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    parsed = docs.select("run_id", read.alias("_d"), (F.trim(F.coalesce("doc", F.lit(""))) == "").alias("_blank"))
    parsed = parsed.select("run_id", "_blank", F.col("_d._bad").isNotNull().alias("_odd"), F.col("_d.resource_changes").alias("_list"))
    return parsed, F.when(F.col("_blank") | (F.col("_odd") & F.col("_list").isNull()), F.lit("unreadable document"))


def read_changes(docs: DataFrame) -> DataFrame:
    """A row per change of ``docs`` (run_id, doc STRING holding JSON), and one for a run without changes.

    ``error`` says why a document cannot be read: it is no JSON object, or its
    change list is no list. A missing or null list is an empty run, whose row has
    actions NULL. A missing type is ``unknown``. Actions that are no list of names
    become ``UNREADABLE``. The document is parsed once.
    """
    parsed, error = _parsed(docs)
    # the outer form, because a plain explode makes Spark infer a filter that parses the document again
    listed = parsed.select("run_id", error.alias("error"), "_odd", F.explode_outer("_list").alias("_c"))
    one = F.col("_c.change")
    missing = F.when(F.col("_odd"), F.array(F.lit(UNREADABLE))).otherwise(F.array().cast("array<string>"))
    return listed.select(
        "run_id",
        "error",
        F.col("_c.address").alias("address"),
        F.coalesce(F.nullif(F.col("_c.type"), F.lit("")), F.lit("unknown")).alias("type"),
        F.when(F.col("_c").isNotNull(), F.coalesce(one["actions"], missing)).alias("actions"),
        one["before"].alias("before"),
        one["after"].alias("after"),
        one["after_unknown"].alias("after_unknown"),
    )


def explode_changes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, errors) of ``docs``; errors has run_id and error for each document that cannot be read."""
    parsed, error = _parsed(docs)
    # a filter on the column itself would be pushed down and parse the document again
    errors = parsed.select("run_id", F.explode_outer(F.array(error)).alias("error")).where(F.col("error").isNotNull())
    return read_changes(docs).where(F.col("actions").isNotNull()).drop("error"), errors


def scan_change_docs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, doc): one JSON document per file, the file name is the run."""
    text = spark.read.text(path, wholetext=True)
    return text.select(_file_stem(F.col("_metadata.file_path")).alias("run_id"), F.col("value").alias("doc"))


def explode_claims(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holders, errors) of lookup ``responses`` (repo, file, body).

    A body that is no JSON object with a ``holders`` list becomes an error row;
    the others go on. ``truncated`` is carried so partial answers show.
    """
    doc = F.try_parse_json("body")
    listed = F.schema_of_variant(F.try_variant_get(F.col("_doc"), "$.holders", "variant"))
    read = responses.withColumn("_doc", doc).withColumn("_is_list", F.startswith(listed, F.lit("ARRAY")))
    good = F.coalesce("_is_list", F.lit(False))
    holder = lambda name, kind: F.try_variant_get(F.col("_h"), f"$.{name}", kind).alias(name)
    holders = (
        read.where(good)
        .withColumn("truncated", F.coalesce(F.try_variant_get("_doc", "$.truncated", "boolean"), F.lit(False)))
        .withColumn("_h", F.explode(F.try_variant_get("_doc", "$.holders", "array<variant>")))
        .select(
            "repo",
            "file",
            holder("kind", "string"),
            holder("machine_id", "string"),
            holder("resource_key", "string"),
            holder("ttl_seconds", "int"),
            "truncated",
        )
    )
    why = F.when(F.col("_doc").isNull(), F.lit("not JSON")).otherwise(F.lit("no holders list"))
    return holders, read.where(~good).select("repo", "file", why.alias("error"))


def scan_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved lookup responses, one JSON object per line with repo, file and body."""
    return explode_claims(spark.read.schema("repo STRING, file STRING, body STRING").json(path))


def scan_logs(spark: SparkSession, path: str, log_group: str, stream: bool = False) -> DataFrame:
    """Lines of ``<ISO time> <message>``, one event per line; a line without a time has ts NULL."""
    reader = spark.readStream if stream else spark.read
    parts = F.split("value", " ", 2)
    ts = F.try_to_timestamp(parts[0])
    return reader.text(path).select(
        F.lit(log_group).alias("log_group"),
        ts.alias("ts"),
        F.when(ts.isNull(), F.col("value")).otherwise(F.coalesce(F.get(parts, 1), F.lit(""))).alias("message"),
    )


def scan_metrics(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Metric points; a point's identity is its namespace, name and dimensions."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(METRIC_SCHEMA).parquet(path)


def with_object_owner(inventory: DataFrame) -> DataFrame:
    """Adds tenant_id and session_id parsed from ``key``; NULL outside the key grammar."""
    return inventory.withColumn("tenant_id", keys.tenant_of_key(F.col("key"))).withColumn(
        "session_id", keys.session_of_key(F.col("key"))
    )


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    schema = "bucket STRING, key STRING, size BIGINT, created TIMESTAMP"
    return with_object_owner(spark.read.schema(schema).parquet(path))


def attribute_map(pairs):
    """``ARRAY<STRUCT<Name, Value>>`` to a map; the last value of a repeated name wins."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["Name"]))
    last = F.transform(
        names, lambda name: F.element_at(F.filter(pairs, lambda p: p["Name"].eqNullSafe(name)), -1)["Value"]
    )
    return F.map_from_arrays(names, last)


def scan_signups(spark: SparkSession, path: str) -> DataFrame:
    schema = "userName STRING, triggerSource STRING, request STRUCT<userAttributes MAP<STRING,STRING>>"
    attrs = F.col("request.userAttributes")
    return spark.read.schema(schema).json(path).select(
        F.col("userName").alias("user_name"),
        F.col("triggerSource").alias("trigger_source"),
        F.try_element_at(attrs, F.lit("email")).alias("email"),
        F.try_element_at(attrs, F.lit("email_verified")).alias("email_verified"),
    )


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    schema = "Username STRING, UserStatus STRING, Attributes ARRAY<STRUCT<Name STRING, Value STRING>>"
    return spark.read.schema(schema).json(path).select(
        "Username",
        "UserStatus",
        attribute_map(F.coalesce("Attributes", F.array().cast("array<struct<Name:string,Value:string>>"))).alias(
            "attributes"
        ),
    )


def scan_table(spark: SparkSession, source: str, table: str | None = None, **options) -> DataFrame:
    """A parquet path, or with ``table`` a JDBC table read in parallel.

    For JDBC pass column, lowerBound, upperBound and numPartitions, so the copy
    is split by a key range rather than read through one connection.
    """
    if table is None:
        return spark.read.parquet(source)
    return spark.read.jdbc(source, table, **options)


def scan_cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """host (file name) and the counter document as VARIANT, NULL when it is no JSON."""
    text = spark.read.text(path, wholetext=True)
    return text.select(
        _file_stem(F.col("_metadata.file_path")).alias("host"), F.try_parse_json("value").alias("doc")
    )


def bucket_root(listing):
    """``STRUCT<objects, size_bytes>`` from disk-usage JSON lines: the last non-empty line's, zeros if there is no line.

    NULL for a listing with a line that is no JSON, as nothing is known then.
    """
    lines = F.filter(F.split(listing, r"\R"), lambda line: F.trim(line) != "")
    broken = F.exists(lines, lambda line: F.try_parse_json(line).isNull())
    root = F.try_parse_json(F.try_element_at(lines, F.lit(-1)))
    number = lambda name: F.coalesce(
        F.try_variant_get(root, f"$.{name}", "bigint"), F.lit(0).cast("bigint")
    )
    return F.when(~broken, F.struct(number("objects").alias("objects"), number("size").alias("size_bytes")))
