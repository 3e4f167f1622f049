"""Registered queries: each is an operator run over the whole given tables.

Where an operator needs a shape the tables do not have (status documents, change
documents, claims), the shape is derived from a whole table by SQL that Spark
and DuckDB both read, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.session import is_folder, spread, write_step

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

# Functions that differ in name only between the two dialects.
_DUCKDB_NAMES = {"timestamp_micros(": "make_timestamp(", "unix_micros(": "epoch_us(", "octet_length(": "strlen("}


def to_duckdb(text: str) -> str:
    """The DuckDB reading of a shared SQL text with {table} placeholders."""
    for spark_name, duckdb_name in _DUCKDB_NAMES.items():
        text = text.replace(spark_name, duckdb_name)
    return text.format(**{name: name for name in TABLE_NAMES})


@dataclass
class Tables:
    """The given parquet tables of one folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df

    def sql(self, text: str, heavy: bool = False) -> DataFrame:
        """A shared SQL text over the tables; ``heavy`` if what follows is bound by CPU, not by reading."""
        used = {name: self(name) for name in TABLE_NAMES if f"{{{name}}}" in text}
        if heavy:
            used = {name: spread(df) for name, df in used.items()}
        return self.spark.sql(text, **used)

    def stream(self, name: str, schema: str) -> DataFrame:
        """The table as a stream of its files; a large table is a folder of them."""
        reader, path = self.spark.readStream.schema(schema), f"{self.folder}/{name}.parquet"
        if is_folder(self.spark, path):
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)  # a stream takes no single file

    def stream_to_the_end(self, name: str, schema: str) -> DataFrame:
        """The table as a stream, with a heartbeat three hours after its last ``ts``.

        A source that ends holds its watermark back, and with it the last results;
        the heartbeat, a row with nothing but a time, moves it past all given rows.
        """
        rows = self(name)
        end = rows.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts"))
        kinds = {field.name: field.dataType for field in T.StructType.fromDDL(schema)}
        beat = end.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
        path = write_step(beat, "heartbeat")
        return self.stream(name, schema).unionByName(self.spark.readStream.schema(schema).parquet(path))


def utc_session(spark: SparkSession) -> SparkSession:
    """``spark``, or where its time zone is another, a sister session with its settings in UTC.

    Given times are UTC, and casts, truncation and literals follow the session's zone.
    """
    zone = "spark.sql.session.timeZone"
    if spark.conf.get(zone) in ("UTC", "Etc/UTC"):
        return spark
    sister = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            sister.conf.set(key, value)
    sister.conf.set(zone, "UTC")
    return sister


RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of ``Tables`` under ``name``, with the DuckDB SQL that must agree."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = function(Tables(utc_session(spark), folder))
            stamps = [c for c, kind in out.dtypes if kind == "timestamp"]
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else out

        RUNS[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register
