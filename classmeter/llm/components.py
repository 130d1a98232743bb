"""Connected components by repeated contraction, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from classmeter.llm.common import saved


def lowest(labels: DataFrame, nodes: DataFrame, **least: str) -> DataFrame:
    """(node, a column for each of `least`) with the smallest value that a node's component has.

    `labels` holds (node, label), `nodes` a row for each node with the columns
    named in `least`. The minima are written, so that the join deals both sides
    anew and Spark can split a large component.
    """
    minima = [F.min(column).alias(name) for name, column in least.items()]
    reached = saved(labels.join(nodes, "node").groupBy("label").agg(*minima), "components")
    return labels.join(reached, "label").select("node", *least)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a long, b long); one label per component.

    In a round every node moves to the smallest of itself and its neighbours,
    edges are relabelled, and those inside one node vanish. The nodes are
    renumbered by a hash first (a bijection on longs), so that a long chain
    shrinks by a constant factor as well and the rounds grow with the
    logarithm of the nodes. A node with very many edges is pre-aggregated in
    the map tasks; its joins are between an edge list and one row for each
    node, which Spark splits where they are skewed. Every round is written to
    the shared folder.
    """
    mix = F.xxhash64
    live = saved(
        edges.where("a <> b").select(mix("a").alias("u"), mix("b").alias("v")).distinct(), "edges"
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", mix("node").alias("at"))
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        down = ends.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("low"))
        down = saved(down.select("u", F.least("u", "low").alias("low")), "moves")
        first = live.join(down, "u").select(F.col("low").alias("a"), "v")
        second = first.join(down.withColumnRenamed("u", "v"), "v").select("a", F.col("low").alias("b"))
        second = second.where("a <> b").select(mix("a").alias("u"), mix("b").alias("v"))
        live = saved(second.distinct(), "edges")
        moved = labels.join(down.withColumnRenamed("u", "at"), "at", "left")
        labels = saved(moved.select("node", mix(F.coalesce("low", "at")).alias("at")), "labels")
    return labels.select("node", F.col("at").alias("label"))
