"""Infrastructure change records: classification, folds and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import change_rules as rules
from fleetscope.session import materialize

#: The worst of a run that has a document which cannot be read.
ERROR = "error"


def classify_changes(changes: DataFrame) -> DataFrame:
    """One drift record per change that is not ``ok``.

    ``changes``: run_id, address, type, actions, before, after, after_unknown.
    A narrow transformation; no before/after value reaches the output, and values are
    compared only where a verdict hangs on the attributes.
    """
    kind, actions, attrs, hits = F.col("type"), F.col("actions"), F.col("_attrs"), F.col("_hits")
    read = rules.judged_by_attributes(actions) | rules.may_be_deploy_owned(kind)
    named = rules.changed_attributes(F.col("before"), F.col("after"), F.col("after_unknown"))
    judged = (
        changes.where(~rules.is_clean(actions))
        .withColumn("_attrs", F.when(read, named).otherwise(F.array().cast("array<string>")))
        .withColumn("_hits", rules.negating_hits(kind, attrs))
        .withColumn("_v", rules.classify_change(kind, actions, attrs, hits))
    )
    return judged.select(
        "run_id",
        F.coalesce(F.nullif("address", F.lit("")), kind).alias("resource"),
        kind.alias("kind"),
        "_v.attribute",
        "_v.classification",
        rules.is_terraform_owned(kind, F.col("_attrs")).alias("terraform_owned"),
        "_v._reason",
    )


def worst_per_run(rows: DataFrame) -> DataFrame:
    """(run_id, worst) of every run in ``read_changes`` rows: its worst class, ``ok`` without changes.

    A run with a document that cannot be read is ``error``, whatever its other
    documents say. One scan, one shuffle; of the values only those are compared
    whose change is a negation, as no other tells classes apart.
    """
    kind, actions = F.col("type"), F.col("actions")
    clean = F.coalesce(rules.is_clean(actions), F.lit(True))
    none = F.array().cast("array<string>")
    hits = rules.changed_negating(kind, F.col("before"), F.col("after"), F.col("after_unknown"))
    judged = rows.withColumn("_hits", F.when(~clean & rules.judged_by_attributes(actions), hits).otherwise(none))
    verdict = rules.classify_change(kind, actions, none, F.col("_hits"))
    classes = sorted(fv.SEVERITY, key=fv.SEVERITY.get)
    rank = (
        F.when(F.col("error").isNotNull(), F.lit(len(classes)))
        .when(clean, F.lit(0))
        .otherwise(rules.severity_rank(verdict["classification"]))
    )
    found = judged.groupBy("run_id").agg(F.max(rank).alias("_rank"))
    names = F.array(*[F.lit(name) for name in (*classes, ERROR)])
    return found.select("run_id", F.element_at(names, F.col("_rank") + 1).alias("worst"))


def drift_summary(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records per run, class and owner; ``runs`` carries run_id and coverage."""
    counted = records.groupBy("run_id", "classification", "terraform_owned").agg(F.count(F.lit(1)).alias("records"))
    return counted.join(runs.select("run_id", "coverage"), "run_id", "left")


def scrub_payload(records: DataFrame, coverage: DataFrame, batch_rows: int = fv.DRIFT_BATCH_ROWS) -> DataFrame:
    """Records without local-only columns, in batches a receiver accepts.

    The records of a run are numbered in the order of their columns and cut every
    ``batch_rows``. They are dealt by range of run and columns, so a large run is
    numbered by many tasks; only a count per run and partition goes beyond them.
    """
    public = [c for c in records.columns if not c.startswith("_")]
    order = ["run_id", *[c for c in public if c != "run_id"]]
    records = materialize(records.select(*public), "records")  # ranges are found by reading the records once more
    dealt = records.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "records")
    part = F.shiftrightunsigned("_at", 33)
    counts = dealt.groupBy("run_id", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("run_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("run_id", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # coverage goes with the few starts, so the records need no join of their own for it
    starts = materialize(starts.join(coverage.select("run_id", "coverage"), "run_id", "left"), "starts")
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return (
        dealt.withColumn("_part", part)
        .join(starts, ["run_id", "_part"])
        .withColumn("batch_id", F.floor(number / batch_rows).cast("bigint"))
        .select(*public, "batch_id", "coverage")
    )
