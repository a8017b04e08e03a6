"""Graph fix-points as bounded loops of joins, each round checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.storage import checkpoints


def reach(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b): b can be reached from a by one or more edges (src, dst), all pairs; paths double each
    round. For small graphs: cycles() and distances() don't need it."""
    checkpoints(edges.sparkSession)
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().checkpoint()
    n = known.count()
    for _ in range(max_rounds):
        further = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        known = known.unionAll(further).distinct().checkpoint()
        if (m := known.count()) == n:
            return known
        n = m
    raise RuntimeError("the closure did not settle")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges less those that start at a node without an entry or end at one without an exit, and so on."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = edges.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst").checkpoint()
        if (m := edges.count()) == n:
            break
        n = m
    return edges


def cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): nodes on a cycle of two or more, named by the component's smallest node.

    Colours: the smallest node that reaches a node is its colour, found by passing it along edges; of a
    colour, the nodes that reach the node it is named after are that node's component. These leave the
    graph, with all edges between colours, and the rest goes on. Work a round is that of the edges.
    """
    checkpoints(edges.sparkSession)
    live = _trimmed(edges.select("src", "dst").where("src <> dst").distinct().checkpoint())
    found = live.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    for _ in range(max_rounds):
        if live.isEmpty():
            return found
        colour = live.select(F.col("src").alias("node")).unionAll(live.select("dst")).distinct().withColumn("c", F.col("node")).checkpoint()
        while True:
            lower = live.join(colour, live.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = colour.join(lower, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")).checkpoint()
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        named = live.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst")
        inside = named.where("c1 = c2").select("src", "dst", F.col("c1").alias("c")).checkpoint()
        front = members = colour.where("node = c")
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = back.join(members, ["node", "c"], "left_anti").checkpoint()
            members = members.unionAll(front)
        members = members.checkpoint()
        several = members.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
        found = found.unionAll(members.join(several, "c", "left_semi").select("node", F.col("c").alias("component")))
        gone = members.select("node")
        rest = inside.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti").select("src", "dst")
        live = _trimmed(rest.checkpoint())
    raise RuntimeError("the components did not settle")


def distances(edges: DataFrame, starts: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, depth): fewest edges from any start; only a round's new nodes go on to the next. Nodes
    further than ``max_depth`` are an error, not left out."""
    checkpoints(edges.sparkSession)
    seen = front = starts.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    links = edges.select("src", "dst").distinct().checkpoint()
    for d in range(1, max_depth + 2):
        front = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
    raise RuntimeError(f"some nodes are more than {max_depth} edges away")


def layer_violations(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges (src, dst) from a lower to a higher rank; ranks: node, rank."""
    lo, hi = (ranks.select(F.col("node").alias(c), F.col("rank").alias(f"{c}_rank")) for c in ("src", "dst"))
    return edges.join(lo, "src").join(hi, "dst").where("src_rank < dst_rank").select("src", "dst", "src_rank", "dst_rank")
