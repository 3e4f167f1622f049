"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.session import materialize, ship_by_value

ship_by_value(__name__)

#: Query vectors sent to every task at once; more are handled in further rounds.
QUERY_BLOCK = 1000


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(query_id, embedding): mean vector per group, averaged per dimension on the map side."""
    means = (
        vectors.select(F.col(group).cast("bigint").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
        .groupBy("query_id", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("y"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda p: p["y"])
    return means.groupBy("query_id").agg(ordered.alias("embedding"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` vectors most similar to each query, ties by vec_id.

    Queries travel to the vectors in blocks of at most ``block``; each Arrow
    batch of vectors answers with its best ``k`` per query, never with all pairs.
    """
    numbered = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(2**31)).alias("_h"))
    numbered = materialize(numbered, "queries")
    rounds = max(1, -(-numbered.count() // max(1, block // 2)))
    best = None
    for number in range(rounds):
        part = numbered.where(F.col("_h") % rounds == number)
        found = vectors.select("vec_id", "embedding").mapInPandas(
            _scorer(part.toPandas(), k), "query_id long, vec_id long, score double"
        )
        best = found if best is None else best.unionAll(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _scorer(queries: pd.DataFrame, k: int):
    ids = queries["query_id"].to_numpy()
    rows = [np.asarray(v, dtype="float64") for v in queries["embedding"]]
    wanted = _unit(np.stack(rows)) if rows else None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if wanted is None or batch.empty:
                continue
            batch = batch.sort_values("vec_id")
            similar = wanted @ _unit(np.stack([np.asarray(v, dtype="float64") for v in batch["embedding"]])).T
            top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(ids, top.shape[1]),
                    "vec_id": batch["vec_id"].to_numpy()[top].ravel(),
                    "score": np.take_along_axis(similar, top, axis=1).ravel(),
                }
            )

    return score
