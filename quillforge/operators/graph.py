"""Graph operators: citation pairs, degrees, isolated nodes, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.staging import staged


def node_of_members(nodes: DataFrame) -> DataFrame:
    """(member, node_id) of each node's members."""
    return nodes.select(F.explode("members").alias("m"), "node_id").select(F.col("m.arxiv_id").alias("member"), "node_id")


def cross_node_edges(references: DataFrame, placed: DataFrame) -> DataFrame:
    """References (citing, cited, ...) between different members of different nodes.

    placed: (member, node_id). Duplicate references stay parallel edges; an id that no node has
    takes its references along. Direction: the cited, older side is the source.
    """
    source = placed.select(F.col("member").alias("cited"), F.col("node_id").alias("source_node"))
    target = placed.select(F.col("member").alias("citing"), F.col("node_id").alias("target_node"))
    return references.where("cited <> citing").join(source, "cited").join(target, "citing").where("source_node <> target_node")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, ends, edges): edge ends at the node, and edges that touch it (a self-loop is one)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("first")), F.struct(F.col("dst").alias("node"), (F.col("src") != F.col("dst")).cast("int").alias("first")))).alias("e"))
    return ends.groupBy("e.node").agg(F.count("*").alias("ends"), F.sum("e.first").cast("long").alias("edges"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(touched, "node", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each end of ``edges`` (src, dst), label the smallest node reached.

    Smallest labels travel along edges, and labels jump to their own labels, so long paths
    halve in every round. All joins are equi-joins, all aggregates combine map-side, rounds are
    staged, and only whether anything changed comes to the driver.
    """
    ways = edges.where("src <> dst").select("src", "dst")
    ways = staged(ways.union(ways.select("dst", "src")).distinct(), "ways")
    labels = staged(ways.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("d")).select("node", F.least("node", "d").alias("label")), "labels")
    while True:
        told = ways.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("to")).agg(F.min("label").alias("heard"))
        heard = labels.join(told, F.col("node") == F.col("to")).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = staged(heard.join(jump, F.col("label") == F.col("at"), "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").limit(1).count() == 0:
            return labels
