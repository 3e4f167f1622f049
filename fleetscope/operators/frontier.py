"""Breadth-first loops over an edge table.

Loops run over steps, never over rows. Each step's new rows are written to the
scratch folder, so plans stay short, sizes are known to the planner (a small
frontier is broadcast and the edges are not shuffled), and a lost executor costs
one step at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.session import materialize, path_exists, scratch_path, sparing_broadcasts, write_step

#: Known nodes that one folder of a large run holds, about.
BUCKET_ROWS = 1_000_000



class Visited:
    """A growing table that tells which rows are new, without reading itself whole at each step.

    New rows are written as a run. When ``RUNS`` runs are of one level, they are written as one of
    the next, so there are few folders and a row is rewritten as often as the logarithm says. A run
    of more than ``bucket_rows`` is split by hash into folders, and only those are read which a
    step's candidates fall into. ``rows_read`` counts the known rows that steps have looked at.
    """

    RUNS = 8

    def __init__(self, spark: SparkSession, schema: StructType, bucket_rows: int = BUCKET_ROWS) -> None:
        self._spark, self._schema, self._bucket_rows = spark, schema, bucket_rows
        self._levels: list[list[tuple[str, int, int]]] = [[]]  # (path, rows, buckets) of the runs of each level
        self.rows_read = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*paths)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self._schema.names), F.lit(buckets))

    def _write(self, df: DataFrame, rows: int) -> tuple[str, int, int]:
        buckets = 1 << max(0, rows // self._bucket_rows).bit_length()
        path = scratch_path(self._spark, "visited")
        if buckets == 1:
            df.write.parquet(path)
        else:
            split = df.withColumn("bucket", self._bucket(buckets)).repartition(buckets, "bucket")
            split.write.partitionBy("bucket").parquet(path)
        return path, rows, buckets

    def _folders(self, run: tuple[str, int, int], touched: list[int] | None) -> list[str]:
        """Where the rows of a run are that ``touched`` buckets hold; None stands for all."""
        path, rows, buckets = run
        wanted = set(range(buckets)) if touched is None else {t % buckets for t in touched}
        self.rows_read += rows * len(wanted) // buckets if touched is not None else 0
        if buckets == 1:
            return [path]
        folders = [f"{path}/bucket={b}" for b in wanted]
        return [folder for folder in folders if path_exists(self._spark, folder)]  # some hold no row

    def add(self, ahead: DataFrame) -> DataFrame:
        """The rows of ``ahead`` that were not known; from now on they are."""
        runs, most = [run for level in self._levels for run in level], 1
        for _, _, buckets in runs:
            most = max(most, buckets)
        touched = [0]
        if most > 1:
            ahead = materialize(ahead, "ahead")
            touched = [r.bucket for r in ahead.select(self._bucket(most).alias("bucket")).distinct().collect()]
        folders = [folder for run in runs for folder in self._folders(run, touched)]
        if folders:
            ahead = ahead.join(self._read(folders), self._schema.names, "left_anti")
        path = write_step(ahead, "visited")
        new = self._read([path])
        rows = new.count()
        if rows:
            self._levels[0].append((path, rows, 1) if rows < self._bucket_rows else self._write(new, rows))
            self._merge()
        self.size = rows
        return new

    def _merge(self) -> None:
        level = 0
        while len(self._levels[level]) >= self.RUNS:
            if level + 1 == len(self._levels):
                self._levels.append([])
            runs = self._levels[level]
            whole = self._read([f for run in runs for f in self._folders(run, None)])
            self._levels[level + 1].append(self._write(whole, sum(r[1] for r in runs)))
            self._levels[level] = []
            level += 1

    def all(self) -> DataFrame:
        return self._read([f for level in self._levels for run in level for f in self._folders(run, None)])


@sparing_broadcasts
def closure(edges: DataFrame, seeds: DataFrame, within: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All nodes reachable from ``seeds`` (column stem) along edges(src, dst), seeds included.

    ``within`` names columns both sides carry and every step keeps, so several
    searches advance in the same steps. A step reads its frontier, the edges and of
    the known nodes at most the buckets its candidates fall into.
    """
    at = ["stem", *within]
    steps = edges.select(F.col("src").alias("stem"), "dst", *within)
    first = seeds.select(*at).distinct()
    known = Visited(seeds.sparkSession, first.schema, bucket_rows)
    frontier = known.add(first)
    if not known.size:
        return frontier
    while known.size:
        ahead = frontier.join(steps, at).select(F.col("dst").alias("stem"), *within).distinct()
        frontier = known.add(ahead)
    return known.all()


def smallest_label(edges: DataFrame, labels: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """labels(stem, label) lowered to the smallest label that reaches each stem.

    Only labels that changed in the last step travel on. ``within`` as above.
    """
    at = ["stem", *within]
    changed = labels
    onward = edges.select(F.col("src").alias("stem"), "dst", *within)
    while True:
        offers = changed.join(onward, at).groupBy(F.col("dst").alias("stem"), *within).agg(F.min("label").alias("offer"))
        merged = materialize(
            labels.join(offers, at, "left").select(
                *at,
                F.least("label", "offer").alias("label"),
                F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved"),
            ),
            "labels",
        )
        labels, changed = merged.drop("moved"), merged.where("moved").drop("moved")
        if changed.isEmpty():
            return labels
