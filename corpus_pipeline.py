"""A corpus pipeline over ``documents``: language ID, line dedup, near duplicates, decontamination, mixing.

Every stage takes what its predecessor kept, as (spark, docs, sf_dir), and its decisions
take effect. All but the last return the columns of documents. Extra columns of any name go through as they
are; no rows give no rows, nulls and repeated rows are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.decontamination import contaminated
from fleetscope.llm.jaccard_join import jaccard_groups
from fleetscope.llm.language_id import UNKNOWN, predict, train
from fleetscope.llm.line_dedup import line_dedup
from fleetscope.llm.mixing import mix_sources
from fleetscope.llm.shared import release
from fleetscope.session import broadcast_if_small, materialize

#: Near duplicates share at least so many percent of their runs of so many words. op7 has its own.
SHINGLE = 5
PERCENT = 80

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents in a batch that goes to Python, unless the session says another number than Spark's own.
BATCH_ROWS = 1_000


def _begin(spark: SparkSession) -> None:
    """The stage before is written by now: its models leave the executors. Whole texts go to Python in small batches."""
    release()
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """(``docs`` with names no operator uses, the new name of each column, columns that restore the old ones)."""
    names = {name: f"{name}_of_{at}" for at, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(new).alias(name) for name, new in names.items()]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those in no language: null, without letters, or
    without a known n-gram. Others stay as they are, whatever their label says."""
    _begin(spark)
    own, names, old = _numbered(docs)
    found = predict(own, train(docs), names["text"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(*old)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars is counted anew.
    A document that loses all its lines stays, with an empty text."""
    _begin(spark)
    own, names, old = _numbered(docs)
    cleaned = line_dedup(own, names["text"]).select(*old)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a Jaccard similarity of at least 0.8 over runs of five words are linked;
    of each group of linked documents the one with the smallest id stays, once.
    Empty documents are linked with nothing and stay, as do rows without an id."""
    _begin(spark)
    groups = materialize(jaccard_groups(docs, size=SHINGLE, percent=PERCENT), "pipeline-groups")
    first = groups.where("doc_id = component_id").select("doc_id")
    others = groups.where("doc_id <> component_id").select("doc_id").distinct().join(first, "doc_id", "left_anti")
    out = docs.join(broadcast_if_small(materialize(others, "pipeline-others")), "doc_id", "left_anti").select(*docs.columns)
    return out.dropDuplicates(["doc_id", "text"]) if first.count() > first.distinct().count() else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. They are named by the hash of their text, which every row has."""
    _begin(spark)
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs.select(key.alias("key"), "text"), items, id_col="key")
    found = broadcast_if_small(materialize(found.select(F.col("doc_id").alias("leak")).distinct(), "pipeline-leaks"))
    own, names, old = _numbered(docs)
    hashed = F.sha2(F.coalesce(names["text"], F.lit("")), 256)
    return own.join(found, hashed == F.col("leak"), "left_anti").select(*old)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken; see :func:`fleetscope.llm.mixing.mix_sources`."""
    _begin(spark)
    return mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Mixing draws at random, which SQL cannot repeat; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
