"""Checks on migrated databases and directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import keys


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of several tables; each is reduced to one row where it is read."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """OK, MISMATCH or, when neither side could be read, UNKNOWN per table."""
    both = source.withColumnRenamed("n", "source_rows").join(
        target.withColumnRenamed("n", "target_rows"), "table_name", "full"
    )
    return both.withColumn(
        "status",
        F.when(F.col("source_rows").isNull() & F.col("target_rows").isNull(), F.lit("UNKNOWN"))
        .when(F.col("source_rows").eqNullSafe(F.col("target_rows")), F.lit("OK"))
        .otherwise(F.lit("MISMATCH")),
    )


def revision_heads(revisions: DataFrame) -> DataFrame:
    """Revisions no other revision of the database names as parent."""
    parents = revisions.where(F.col("parent").isNotNull()).select("db", F.col("parent").alias("revision")).distinct()
    return revisions.select("db", "revision").distinct().join(parents, ["db", "revision"], "left_anti")


def revision_status(revisions: DataFrame, stamped: DataFrame) -> DataFrame:
    """Per database: head count and whether the stamped revision is the only head."""
    heads = revision_heads(revisions).groupBy("db").agg(
        F.count(F.lit(1)).alias("head_count"), F.min("revision").alias("_head")
    )
    current = F.nullif(F.col("revision").cast("string"), F.lit(""))
    healthy = current.isNotNull() & (F.col("head_count") == 1) & (F.col("_head").cast("string") == current)
    return stamped.join(heads, "db", "full").select(
        "db",
        F.coalesce("head_count", F.lit(0).cast("bigint")).alias("head_count"),
        F.coalesce(healthy, F.lit(False)).alias("healthy"),
    )


def email_violations(accounts: DataFrame) -> DataFrame:
    """Accounts whose e-mail a case-sensitive unique lookup would miss."""
    return accounts.where(~keys.email_is_canonical(F.col("email")))
