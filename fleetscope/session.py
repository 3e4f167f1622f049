"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 200_000

#: Files of a table that a loop over graph steps broadcasts, in bytes at most.
LOOP_BROADCAST_BYTES = 256 << 10


def build_session(app: str = "fleetscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is required: every operator also runs in a plain session.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` names it. Where it is unset, a session on one machine
    (``local[...]``) gets a folder that goes with the process; on a cluster that is
    an error, because a folder only one machine sees would lose data with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="fleetscope-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/fleetscope/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables this application has written so far.

    Results are lazy and read these tables: call it when they were written or collected.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def write_step(df: DataFrame, label: str = "step") -> str:
    """Write ``df`` to the scratch folder and return where."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage in a way that outlives lost executors, and gives Catalyst the
    true size, so later joins pick broadcast or shuffle from facts.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_step(df, label))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed values as a table whose size Catalyst knows."""
    names = [field.strip().split(" ")[0] for field in schema.split(", ")]
    columns = dict(zip(names, map(list, zip(*rows))))
    return spark.createDataFrame(pa.table(columns), schema)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count proves the side is small.

    Beyond ``max_rows`` the side comes back unhinted and is joined by shuffle,
    where adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sparing_broadcasts(function):
    """``function`` (of a graph or edges), in which a join broadcasts no table above ``LOOP_BROADCAST_BYTES``.

    What is broadcast goes through the driver. Loops plan joins by the hundred, so with Spark's limit
    for one join their sum grows with the input up to a hundred times that limit.
    """

    @functools.wraps(function)
    def run(over, *args, **kwargs):
        spark, name = getattr(over, "edges", over).sparkSession, "spark.sql.autoBroadcastJoinThreshold"
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(name, min(limit, LOOP_BROADCAST_BYTES))
        try:
            return function(over, *args, **kwargs)
        finally:
            spark.conf.set(name, limit)

    return run


def spread(df: DataFrame) -> DataFrame:
    """Spread a source with fewer splits than cores, as a small single file is, over all cores.

    A large source has more splits than cores and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_by_value(module: str) -> None:
    """Send the module's Python functions with the tasks, as executors have no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
