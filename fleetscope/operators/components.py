"""Cyclic nodes, strongly connected components and the cycles in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.frontier import smallest_label
from fleetscope.session import materialize, sparing_broadcasts


def _end(column: str, entered: bool):
    return F.struct(F.col(column).alias("stem"), F.lit(entered).alias("entered"))


def _trim(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: something enters their source and leaves their target.

    Goes on while it at least halves the edges; what is left over is for the labels.
    """
    before = None
    while True:
        ends = edges.select(F.explode(F.array(_end("src", False), _end("dst", True))).alias("e")).select("e.*")
        inner = ends.groupBy("stem").agg(F.min("entered").alias("never_left"), F.max("entered").alias("entered"))
        inner = inner.where("entered AND NOT never_left").select("stem")
        edges = edges.join(inner.withColumnRenamed("stem", "src"), "src", "left_semi").join(
            inner.withColumnRenamed("stem", "dst"), "dst", "left_semi"
        )
        edges = materialize(edges.select("src", "dst"), "trim")
        now = edges.count()
        if now == 0 or (before is not None and now * 2 > before):
            return edges
        before = now


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as it is (way ``down``) and turned round (way ``up``)."""
    down, up = F.lit("down").alias("way"), F.lit("up").alias("way")
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), up)
    return edges.select(F.explode(F.array(F.struct("src", "dst", down), turned)).alias("e")).select("e.*")


def _through_nodes(edges: DataFrame) -> DataFrame:
    """(stem): nodes that one edge enters and one edge leaves."""
    ends = edges.select(F.explode(F.array(_end("src", False), _end("dst", True))).alias("e")).select("e.*")
    degrees = ends.groupBy("stem").agg(F.count_if("entered").alias("into"), F.count_if(~F.col("entered")).alias("out"))
    return degrees.where("into = 1 AND out = 1").select("stem")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, paths, rings) of ``edges`` without repeats and self-edges.

    Paths of nodes with one edge in and one out become one edge: ``core`` holds what
    is left, ``paths`` (stem, src, dst) the nodes on them with the ends, which are
    ``src`` and ``dst``. Nodes of a ring of nothing but such nodes are in ``rings``
    (stem, scc). Ends are found by doubling the distance, so rounds grow with the
    logarithm of the longest path.
    """
    through = materialize(_through_nodes(edges), "through")
    ways = both_ways(edges).select(F.col("src").alias("stem"), "way", F.col("dst").alias("to"))
    inside = through.withColumnRenamed("stem", "to").withColumn("open", F.lit(True))
    jumps = ways.join(through, "stem", "left_semi").join(inside, "to", "left")
    jumps = materialize(jumps.select("stem", "way", "to", F.least("stem", "to").alias("low"), F.coalesce("open", F.lit(False)).alias("open")), "jump")
    reach, size = 1, through.count()
    while reach <= size and not jumps.where("open").isEmpty():
        ahead = jumps.select(F.col("stem").alias("to"), "way", F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        onward = F.col("open") & F.col("_to").isNotNull()
        jumps = materialize(
            jumps.join(ahead, ["to", "way"], "left").select(
                "stem",
                "way",
                F.when(onward, F.col("_to")).otherwise(F.col("to")).alias("to"),
                F.when(onward, F.least("low", "_low")).otherwise(F.col("low")).alias("low"),
                F.when(onward, F.col("_open")).otherwise(F.col("open")).alias("open"),
            ),
            "jump",
        )
        reach *= 2
    at_end = lambda way: F.max(F.when(F.col("way") == way, F.col("to")))
    paths = jumps.where("NOT open").groupBy("stem").agg(at_end("up").alias("src"), at_end("down").alias("dst"))
    paths = materialize(paths, "paths")
    rings = jumps.where("open AND way = 'down'").select("stem", F.col("low").alias("scc"))
    plain = edges.join(through.withColumnRenamed("stem", "src"), "src", "left_anti").join(
        through.withColumnRenamed("stem", "dst"), "dst", "left_anti"
    )
    core = plain.select("src", "dst").unionByName(paths.select("src", "dst")).distinct()
    return materialize(core, "core"), paths, rings


@sparing_broadcasts
def strongly_connected(edges: DataFrame) -> DataFrame:
    """(stem, scc) of every node that reaches itself; scc is its component's smallest stem.

    Trims what cannot be cyclic and contracts paths, then repeats on what is left:
    find for every node the smallest stem that reaches it and the smallest it
    reaches. Where both are one stem, that stem names the node's component. Nodes
    where either differs are in different components, so edges between them go, and
    the rest is searched again, all parts at once. State is two labels per node,
    never pairs of nodes. A node on a path is in the component of both its ends.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    core, paths, rings = _contracted(_trim(edges.where("src <> dst")))
    loops = edges.where("src = dst").unionByName(core.where("src = dst")).select(F.col("src").alias("stem")).distinct()
    rest, found = core.where("src <> dst"), None
    while not (rest := _trim(rest)).isEmpty():
        ways = both_ways(rest)
        start = ways.select(F.col("src").alias("stem"), "way", F.col("src").alias("label")).distinct()
        labels = smallest_label(ways, materialize(start, "labels"), within=("way",))
        reached, reaches = (F.max(F.when(F.col("way") == way, F.col("label"))) for way in ("down", "up"))
        nodes = materialize(labels.groupBy("stem").agg(reached.alias("above"), reaches.alias("below")), "nodes")
        named = nodes.where("above = below").select("stem", F.col("above").alias("scc"))
        found = named if found is None else found.unionByName(named)
        unnamed = nodes.where("above <> below")
        rest = (
            rest.join(unnamed.toDF("src", "above", "below"), "src")
            .join(unnamed.toDF("dst", "above", "below"), ["dst", "above", "below"])
            .select("src", "dst")
        )
    alone = loops.withColumn("scc", F.col("stem"))
    if found is not None:
        # a stem alone under its name is a bridge between cycles, not a cycle
        real = found.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.join(real, "scc", "left_semi").select("stem", "scc")
        alone = found.unionByName(alone.join(found, "stem", "left_anti"))
    known = materialize(alone, "known")
    ends = paths.join(known.toDF("src", "scc"), "src").join(known.toDF("dst", "_to"), "dst").where("scc = _to")
    members = known.unionByName(ends.select("stem", "scc")).unionByName(rings).dropDuplicates(["stem"])
    lowest = members.groupBy("scc").agg(F.min("stem").alias("low"))
    return members.join(lowest, "scc").select("stem", F.col("low").alias("scc"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return strongly_connected(edges).select("stem")


def _shortest_rings(edges: DataFrame) -> DataFrame:
    """Per component of edges(scc, src, dst), one shortest cycle through its smallest stem.

    Breadth first from that stem with the smallest parent kept per node, then
    back along the parents; all components advance in the same step.
    """
    start = edges.select("scc").distinct().select(
        "scc", F.col("scc").alias("stem"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth")
    )
    frontier = materialize(start, "ring")
    seen, closings, depth = frontier, [], 0
    while not frontier.isEmpty():
        depth += 1
        ahead = (
            frontier.select("scc", F.col("stem").alias("src"))
            .join(edges, ["scc", "src"])
            .groupBy("scc", F.col("dst").alias("stem"))
            .agg(F.min("src").alias("parent"))
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        ahead = materialize(ahead, "ring")
        closed = ahead.where("stem = scc")
        closings.append(closed)
        frontier = materialize(
            ahead.join(closed, "scc", "left_anti").join(seen, ["scc", "stem"], "left_anti"), "ring"
        )
        seen = seen.unionByName(frontier)
    at = closings[0] if closings else start.limit(0)
    for more in closings[1:]:
        at = at.unionByName(more)
    at = materialize(at.select("scc", "stem", "parent", "depth"), "ring")
    rings = at.select("scc", F.col("depth").alias("position"), "stem")
    while not at.isEmpty():
        back = at.where("depth > 0").select("scc", F.col("parent").alias("stem"), (F.col("depth") - 1).alias("depth"))
        at = materialize(back.join(seen, ["scc", "stem", "depth"]).select("scc", "stem", "parent", "depth"), "ring")
        rings = rings.unionByName(at.select("scc", F.col("depth").alias("position"), "stem"))
    return rings.select("scc", F.lit(0).alias("cycle_no"), "position", "stem")


@sparing_broadcasts
def cycles(edges: DataFrame) -> DataFrame:
    """(scc, cycle_no, position, stem): one shortest cycle through each component's smallest stem.

    It starts and ends with that stem; where several are as short, the smallest
    predecessors are taken. ``cyclic_nodes`` names every node on any cycle. The rule
    is the same for components of any size; all are searched in the same steps.
    """
    component = materialize(strongly_connected(edges), "component")
    inner = (
        edges.select("src", "dst")
        .distinct()
        .join(component.toDF("src", "scc"), "src")
        .join(component.toDF("dst", "_to"), "dst")
        .where(F.col("scc") == F.col("_to"))
        .select("scc", "src", "dst")
    )
    return _shortest_rings(materialize(inner, "component-edges"))
