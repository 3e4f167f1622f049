"""Status documents to dependencies, and what blocks each work item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import text_rules as rules
from fleetscope.session import materialize


def prefer_active(plans: DataFrame) -> DataFrame:
    """One document per stem, the lowest source_rank first."""
    first = Window.partitionBy("stem").orderBy("source_rank", "location")
    return plans.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def parse_plans(plans: DataFrame, no_word: str = fv.NO_BLOCK) -> DataFrame:
    """stem, location, has_block, status, summary and depends_on of each document.

    The text is read once, before documents are compared, so only the parsed
    columns are shuffled.
    """
    parsed = plans.withColumn("_block", rules.status_block(F.col("text"))).select(
        "stem",
        "location",
        "source_rank",
        F.col("_block").isNotNull().alias("has_block"),
        rules.status_word(F.col("_block"), no_word).alias("status"),
        rules.summary(F.col("_block")).alias("summary"),
        rules.depends_on(F.col("_block")).alias("depends_on"),
    )
    return prefer_active(parsed).drop("source_rank")


def parsed_table(plans: DataFrame, no_word: str = fv.NO_BLOCK) -> DataFrame:
    """``parse_plans`` written once, for uses that read it several times, so no text is parsed twice."""
    return materialize(parse_plans(plans, no_word), "parsed")


def resolve_deps(parsed: DataFrame) -> DataFrame:
    """One row per declared dependency with its status, place and blocking reason."""
    declared = parsed.select(F.col("stem").alias("plan_stem"), F.posexplode("depends_on").alias("position", "stem"))
    known = parsed.select("stem", "status", "location", "summary")
    return (
        declared.join(known, "stem", "left")
        .withColumn("status", F.coalesce("status", F.lit(fv.MISSING)))
        .select(
            "plan_stem", "position", "stem", "status", "location", "summary",
            rules.unsatisfied_reason(F.col("status")).alias("reason"),
        )
    )


def all_satisfied(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per plan: dependency count, blocked count and whether nothing blocks it."""
    zero = F.lit(0).cast("bigint")
    counted = resolved.groupBy("plan_stem").agg(
        F.count(F.lit(1)).alias("dependencies"), F.count("reason").alias("unsatisfied")
    )
    return (
        parsed.select(F.col("stem").alias("plan_stem"))
        .join(counted, "plan_stem", "left")
        .select(
            "plan_stem",
            F.coalesce("dependencies", zero).alias("dependencies"),
            F.coalesce("unsatisfied", zero).alias("unsatisfied"),
            (F.coalesce("unsatisfied", zero) == 0).alias("all_satisfied"),
        )
    )


def dependency_edges(parsed: DataFrame) -> DataFrame:
    """Distinct edges ``src`` depends on ``dst``; parsed lists hold no repeats."""
    return parsed.select(F.col("stem").alias("src"), F.explode("depends_on").alias("dst"))


def missing_deps(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Declared targets without a document."""
    return edges.select(F.col("dst").alias("stem")).distinct().join(plans.select("stem"), "stem", "left_anti")
