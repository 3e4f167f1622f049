"""Models sent to the tasks, and taken off the executors again.

Executors have no copy of this package. A broadcast names classes instead of holding them, so a
model travels as bytes that hold its class too.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_held = []


def share(spark: SparkSession, value):
    """A broadcast of plain values, such as tuples of arrays."""
    held = spark.sparkContext.broadcast(value)
    _held.append(held)
    return held


def share_model(spark: SparkSession, model):
    """A broadcast of a model's bytes; ``pickle.loads`` in a task gives the model."""
    return share(spark, cloudpickle.dumps(model))


def release() -> None:
    """Takes everything shared so far off the executors; what is used again is sent again."""
    while _held:
        held = _held.pop()
        try:
            held.unpersist()
        except Exception:  # its session has ended
            continue
