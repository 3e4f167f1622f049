"""Claims held by other machines on files and working trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import keys


def scope_files(changed: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct non-blank relative paths of both lists, per repository."""
    both = changed.select("repo", "rel_file").union(untracked.select("repo", "rel_file"))
    trimmed = both.select("repo", F.regexp_replace("rel_file", r"^\s+|\s+$", "").alias("rel_file"))
    return trimmed.where(F.col("rel_file") != "").distinct()


def dedup_in_order(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each key; ``dropDuplicates`` does where order does not matter."""
    first = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def live_claims(claims: DataFrame, as_of: Column) -> DataFrame:
    """Claims whose time to live has not run out at ``as_of``."""
    ends = F.col("observed_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))
    return claims.where(ends > as_of)


def claims_on_files(files: DataFrame, claims: DataFrame) -> DataFrame:
    """Symbol claims under each file, as an equi-join.

    A claim is listed under all colon-terminated prefixes of its key and joined
    on equality, so the plan is a hash or sort-merge join, never a nested loop.
    """
    listed = claims.where(F.col("kind") == "symbol").withColumn(
        "_prefix", F.explode(keys.file_prefixes(F.col("resource_key")))
    )
    wanted = files.select("repo", "rel_file", F.concat_ws(":", "repo", "rel_file", F.lit("")).alias("_prefix"))
    return listed.join(wanted, "_prefix").select(
        "repo",
        F.col("rel_file").alias("file"),
        keys.symbol_tail(F.col("resource_key")).alias("symbol"),
        "machine_id",
        "ttl_seconds",
        "resource_key",
    )


def exclude_self(holders: DataFrame, local_id: Column) -> DataFrame:
    """Drop own claims; with an unknown local id, or an unknown holder, keep them."""
    return holders.where(~keys.is_self(F.col("machine_id"), local_id))


def conflict_summary(conflicts: DataFrame, errors: DataFrame) -> DataFrame:
    """Conflicts, distinct machines and failed lookups per repository and file."""
    found = conflicts.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("conflicts"), F.count_distinct("machine_id").alias("machines")
    )
    failed = errors.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("errors"))
    zero = F.lit(0).cast("bigint")
    return found.join(failed, ["repo", "file"], "full").select(
        "repo",
        "file",
        F.coalesce("conflicts", zero).alias("conflicts"),
        F.coalesce("machines", zero).alias("machines"),
        F.coalesce("errors", zero).alias("errors"),
        (F.coalesce("conflicts", zero) > 0).alias("has_conflict"),
    )


def lookup_tree_claim(calls: DataFrame, claims: DataFrame, now: Column | None = None) -> DataFrame:
    """Calls with the newest claim on the tree they touch, if any; with ``now``, of the claims live then.

    Of claims seen at one time the largest machine and session holds.
    """
    if now is not None:
        claims = live_claims(claims, now)
    newest = (
        claims.where(F.col("kind") == "worktree")
        .groupBy(F.col("resource_key").alias("key"))
        .agg(
            F.max_by(F.struct("machine_id", "session_id"), F.struct("observed_at", "machine_id", "session_id")).alias("holder")
        )
    )
    return calls.withColumn("key", keys.normalize_resource_key(F.col("path"))).join(newest, "key", "left")


def guard_decision(calls: DataFrame) -> DataFrame:
    """ALLOW, WARN or BLOCK for each attempted tree operation.

    Input is ``lookup_tree_claim`` output with skip, enforce, tool_present,
    in_tree and lookup_ok flags. Every doubt allows; only a proven conflict
    warns, or blocks where enforcement is on.
    """
    holder = F.nullif("holder.machine_id", F.lit(""))
    holder_session = F.nullif("holder.session_id", F.lit(""))
    caller = F.nullif("machine_id", F.lit(""))
    allow = {
        "skip": F.col("skip"),
        "no-tool": ~F.col("tool_present"),
        "not-a-tree": ~F.col("in_tree"),
        "no-identity": caller.isNull(),
        "lookup-failed": ~F.col("lookup_ok"),
    }
    reason = F.when(F.lit(False), F.lit(""))
    for name, test in allow.items():
        reason = reason.when(F.coalesce(test, F.lit(False)), F.lit(name))
    reason = (
        reason.when(F.col("holder").isNull(), F.lit("no claim held"))
        .when(holder.isNull(), F.lit("no-holder-field"))
        .when(holder != caller, F.lit("held by another machine"))
        .when(
            holder_session.isNull() | holder_session.eqNullSafe(F.nullif("session_id", F.lit(""))), F.lit("held-by-us")
        )
        .otherwise(F.lit("held by another session"))
    )
    conflict = F.col("reason").isin("no claim held", "held by another machine", "held by another session")
    return calls.withColumn("reason", reason).withColumn(
        "decision",
        F.when(conflict & F.coalesce("enforce", F.lit(False)), F.lit("BLOCK"))
        .when(conflict, F.lit("WARN"))
        .otherwise(F.lit("ALLOW")),
    )


def guard_decision_counts(lines: DataFrame) -> DataFrame:
    """Decisions and reasons counted from ``<ts> pid=<n> <DECISION> reason=…`` log lines."""
    pattern = r'^\S+ pid=\d+ ((?:ALLOW|WARN|BLOCK) reason=(?:"[^"]*"|\S+))'
    found = lines.select(F.regexp_extract("message", pattern, 1).alias("_found")).where(F.col("_found") != "")
    at = F.instr("_found", " reason=")
    return (
        found.groupBy("_found")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.substring("_found", F.lit(1), at - 1).alias("decision"),
            F.replace(F.substring("_found", at + len(" reason="), F.length("_found")), F.lit('"'), F.lit("")).alias("reason"),
            "_n",
        )
        .groupBy("decision", "reason")
        .agg(F.sum("_n").alias("fires"))
    )
