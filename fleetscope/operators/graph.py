"""Graph questions over edges(src, dst) and nodes(stem, status, location).

The functions that loop do so over graph steps, see ``frontier``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import dependencies as deps
from fleetscope.operators.components import both_ways, strongly_connected
from fleetscope.operators.frontier import closure
from fleetscope.session import materialize, sparing_broadcasts


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    missing: DataFrame


def build_graph(plans: DataFrame) -> Graph:
    """Nodes, edges and missing targets of the status documents."""
    parsed = deps.parsed_table(plans, no_word=fv.NO_WORD)
    edges = deps.dependency_edges(parsed)
    missing = deps.missing_deps(edges, parsed)
    ghosts = missing.select("stem", F.lit(fv.MISSING).alias("status"), F.lit(None).cast("string").alias("location"))
    return Graph(parsed.select("stem", "status", "location").unionByName(ghosts), edges, missing)


def in_degree(edges: DataFrame) -> DataFrame:
    """Distinct dependants per node."""
    return edges.groupBy(F.col("dst").alias("stem")).agg(F.count_distinct("src").alias("dependants"))


def reachable_from(graph: Graph, root: str) -> DataFrame:
    """``root`` and its transitive dependencies; an unknown root is one MISSING node."""
    spark = graph.edges.sparkSession
    seed = spark.createDataFrame([(root,)], "stem string")
    found = closure(graph.edges, seed).join(graph.nodes, "stem", "left")
    return found.select("stem", F.coalesce("status", F.lit(fv.MISSING)).alias("status"), "location")


def reachable_subgraph(graph: Graph, root: str) -> Graph:
    """The part of the graph ``root`` reaches: its nodes, the edges they have, and which of them are missing.

    What a node inside depends on is inside, so an edge belongs when its source does. An unknown
    root is one MISSING node without edges.
    """
    nodes = materialize(reachable_from(graph, root), "reached")
    edges = graph.edges.join(nodes.select(F.col("stem").alias("src")), "src", "left_semi")
    return Graph(nodes, edges.select("src", "dst"), nodes.where(F.col("status") == fv.MISSING).select("stem"))


def contained_cycles(cycles: DataFrame, part: Graph) -> DataFrame:
    """Cycles of the whole graph that lie in a part closed under dependencies.

    Such a part holds a cyclic component whole or not at all, so its smallest stem decides.
    """
    return cycles.join(part.nodes.select(F.col("stem").alias("scc")), "scc", "left_semi")


@sparing_broadcasts
def visible(graph: Graph, include_shipped: bool = False) -> DataFrame:
    """Stems to show: unfinished ones, all they depend on, and all that depend on them."""
    if include_shipped:
        return graph.nodes.select("stem")
    unfinished = graph.nodes.where(~F.col("status").isin(*fv.FINISHED_WORDS)).select("stem")
    ways = F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way")
    return closure(both_ways(graph.edges), unfinished.select("stem", ways), within=("way",)).select("stem").distinct()


@sparing_broadcasts
def roots(graph: Graph, shown: DataFrame) -> DataFrame:
    """Entry points of the shown part: nodes nothing shown depends on.

    With none, the smallest stem is the entry. Cyclic parts no entry reaches get
    the smallest stem of each of their source components.
    """
    shown = materialize(shown.select("stem"), "shown")
    inner = graph.edges.join(shown.withColumnRenamed("stem", "src"), "src", "left_semi").join(
        shown.withColumnRenamed("stem", "dst"), "dst", "left_semi"
    )
    inner = materialize(inner.select("src", "dst"), "inner")
    depended = inner.select(F.col("dst").alias("stem")).distinct()
    free = materialize(shown.join(depended, "stem", "left_anti"), "free")
    if free.isEmpty():
        free = shown.agg(F.min("stem").alias("stem")).where("stem IS NOT NULL")
    unreached = materialize(shown.join(closure(inner, free), "stem", "left_anti"), "unreached")
    if unreached.isEmpty():
        return free
    return free.union(_source_entries(inner, unreached))


def _source_entries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    inside = edges.join(nodes.withColumnRenamed("stem", "src"), "src", "left_semi").join(
        nodes.withColumnRenamed("stem", "dst"), "dst", "left_semi"
    )
    component = strongly_connected(inside.select("src", "dst"))
    labelled = inside.join(component.toDF("src", "from_scc"), "src", "left").join(
        component.toDF("dst", "to_scc"), "dst", "left"
    )
    entered = labelled.where(~F.col("from_scc").eqNullSafe(F.col("to_scc")) & F.col("to_scc").isNotNull())
    entered = entered.select(F.col("to_scc").alias("scc")).distinct()
    return component.select("scc").distinct().join(entered, "scc", "left_anti").toDF("stem")


def ordered_graph(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by stem, edges by (from, to), missing by stem."""
    return (
        graph.nodes.orderBy("stem"),
        graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).orderBy("from", "to"),
        graph.missing.orderBy("stem"),
    )
