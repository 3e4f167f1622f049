"""Cold objects of closed sessions, each written once, however many writers there are.

A writer stages its parts and a manifest of them under a name of its own, where no reader looks.
It then puts a numbered record into the log, which names the manifest; creating the record fails if
another writer has put that number first. In that case the sessions which the others have written
are taken out of the manifest, and the next number is tried. Readers follow the log: a session is
there when a record is, with all its parts, and comes from one writer. What a writer staged before
it failed is never seen, and committing a name again does nothing.

    <path>/parts/<name>/tenant_id=...    bodies, in parts
    <path>/staged/<name>                 a row per session staged
    <path>/manifest/<name>-<number>      a row per session that record <number> adds
    <path>/log/<number>                  the record, one small file a commit
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import retention

MANIFEST = "tenant_id string, session_id string, chunks bigint, size_bytes bigint, parts bigint, object_key string"
_PARTS = "session_id string, part_no bigint, body binary, tenant_id string"
_SESSION = ["tenant_id", "session_id"]


def _files(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _log(spark: SparkSession, path: str) -> list[str]:
    """Manifest names in the order of their records, one for each commit."""
    files, folder = _files(spark, f"{path}/log")
    if not files.exists(folder):
        return []
    known = sorted(s.getPath().getName() for s in files.listStatus(folder) if not s.getPath().getName().startswith("."))
    names = []
    for number in known:
        record = files.open(_files(spark, f"{path}/log/{number}")[1])
        try:
            names.append(bytes(record.readAllBytes()).decode())
        finally:
            record.close()
    return names


def _put_record(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Creates a record of the log, or gives False if it is there already."""
    files, at = _files(spark, f"{path}/log/{number:012d}")
    try:
        record = files.create(at, False)
    except Exception:
        if files.exists(at):
            return False
        raise
    record.write(name.encode())
    record.close()
    return True


def stage(chunks: DataFrame, path: str, **sizes: int) -> str:
    """Writes the bodies of all closed sessions under a new name, which it gives back; no reader sees them yet.

    ``chunks``: tenant_id, session_id, seq, bytes, closed_at. Rows are spread by range, so a busy
    tenant is written by many tasks and a quiet one by few. Sessions that are committed are left out.
    """
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    closed = chunks.where(F.col("closed_at").isNotNull())
    closed = closed.join(read_manifest(spark, path).select(*_SESSION), _SESSION, "left_anti")
    bodies = retention.cold_objects(closed, **sizes)
    spread = bodies.repartitionByRange("tenant_id", "session_id", "part_no")
    spread.write.partitionBy("tenant_id").parquet(f"{path}/parts/{name}")
    written = spark.read.schema(_PARTS + ", chunks bigint").parquet(f"{path}/parts/{name}")
    retention.cold_manifest(written).write.parquet(f"{path}/staged/{name}")
    return name


def commit(spark: SparkSession, path: str, name: str) -> int:
    """Makes what was staged under ``name`` visible, without the sessions others have committed; returns how many are added."""
    staged = spark.read.schema(MANIFEST).parquet(f"{path}/staged/{name}")
    while True:
        log = _log(spark, path)
        if any(known.startswith(f"{name}-") for known in log):
            return 0
        number = len(log)
        added = staged.join(_manifest(spark, path, log).select(*_SESSION), _SESSION, "left_anti")
        added.write.mode("overwrite").parquet(f"{path}/manifest/{name}-{number}")
        if _put_record(spark, path, number, f"{name}-{number}"):
            return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{name}-{number}").count()


def write(chunks: DataFrame, path: str, **sizes: int) -> int:
    """Stages and commits; a session that is there is never touched."""
    return commit(chunks.sparkSession, path, stage(chunks, path, **sizes))


def _manifest(spark: SparkSession, path: str, log: list[str]) -> DataFrame:
    if not log:
        return spark.createDataFrame([], MANIFEST + ", writer string")
    rows = spark.read.schema(MANIFEST).parquet(*[f"{path}/manifest/{name}" for name in log])
    writer = F.regexp_extract("_metadata.file_path", r"/manifest/([0-9a-f]{32})-\d+/", 1)
    return rows.withColumn("writer", writer)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, session_id, chunks, size_bytes, parts, object_key), a row per committed session."""
    return _manifest(spark, path, _log(spark, path)).drop("writer")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, session_id, part_no, body, object_key): the parts of committed sessions; in order they are the object."""
    log = _log(spark, path)
    whole = _manifest(spark, path, log).select(*_SESSION, "object_key", "writer")
    if not log:
        return whole.select(*_SESSION, F.lit(0).cast("bigint").alias("part_no"), F.lit(b"").alias("body"), "object_key")
    folders = sorted({f"{path}/parts/{name.rsplit('-', 1)[0]}" for name in log})
    parts = [
        spark.read.schema(_PARTS).option("basePath", folder).parquet(folder).withColumn("writer", F.lit(folder.rsplit("/", 1)[1]))
        for folder in folders
    ]
    held = parts[0]
    for more in parts[1:]:
        held = held.unionByName(more)
    return held.join(whole, [*_SESSION, "writer"]).select(*_SESSION, "part_no", "body", "object_key")
