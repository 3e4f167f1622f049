"""Sinks. All write distributed tables; nothing is gathered on the driver. Cold objects: ``cold_store``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetscope.operators import metrics
from fleetscope.operators.graph import Graph, ordered_graph


def write_graph(graph: Graph, cycles: DataFrame, path: str) -> None:
    """Four sorted JSON-lines tables under ``path``: nodes, edges, missing, cycles."""
    nodes, edges, missing = ordered_graph(graph)
    tables = {"nodes": nodes, "edges": edges, "missing": missing}
    tables["cycles"] = cycles.orderBy("scc", "cycle_no", "position")
    for name, table in tables.items():
        table.write.json(f"{path}/{name}")


def write_payload(batches: DataFrame, path: str) -> None:
    """Scrubbed drift records sorted by run and batch; rows keep the batch they are sent in."""
    order = ("run_id", "batch_id")
    batches.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def write_exposition(rows: DataFrame, path: str) -> None:
    """Exposition lines with their owner and number, in that order; not a folder for every host."""
    ordered = rows.repartitionByRange("owner", "line_no").sortWithinPartitions("owner", "line_no")
    ordered.select("owner", "line_no", "line").write.parquet(path)


def write_alarm_actions(transitions: DataFrame, path: str) -> None:
    """Append the notifications that are due."""
    metrics.alarm_actions(transitions).write.mode("append").parquet(path)
