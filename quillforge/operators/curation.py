"""Curating a graph (C1-C9): every function gives new nodes and edges; the audit grows by one entry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.schemas import EDIT

#: The relationship types an edge may have.
EDGE_TYPES = ("extends", "contests", "narrows", "renames", "merges", "migrates")


def rewire(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Ends at ``src`` go to ``dst``; then no self-loop is left, old ones included."""
    to = lambda c: F.when(F.col(c) == src, F.lit(dst)).otherwise(F.col(c))
    return edges.withColumn("source_node", to("source_node")).withColumn("target_node", to("target_node")).where("source_node <> target_node")


def merge(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """``src``'s members (by year, unknown last) and definition ids (ascending) join ``dst``'s.

    The span is that of all known years, null without one. An unknown node changes nothing.
    """
    # Whether both nodes are there is a scalar subquery: nothing runs before the result is asked for.
    both = (nodes.where(F.col("node_id").isin(src, dst)).agg(F.count_distinct("node_id")).scalar() == 2) & F.lit(src != dst)
    gone = nodes.where(F.col("node_id") == src).where(both).select(F.lit(dst).alias("node_id"), F.col("members").alias("_m"), F.col("definition_ids").alias("_d"))
    late = lambda m, i: F.struct(F.coalesce(F.nullif(m["year"], F.lit(0)), F.lit(9999)).alias("k"), i.alias("i"), m.alias("m"))
    joined = nodes.where((F.col("node_id") != src) | ~both).join(gone, "node_id", "left")
    changed = F.col("_m").isNotNull()
    members = F.when(changed, F.transform(F.array_sort(F.transform(F.concat("members", "_m"), late)), lambda x: x["m"])).otherwise(F.col("members"))
    ids = F.when(F.col("_d").isNotNull(), F.array_sort(F.array_union("definition_ids", "_d"))).otherwise(F.col("definition_ids"))
    out = joined.withColumn("members", members).withColumn("definition_ids", ids)
    years = F.filter(F.transform("members", lambda m: F.nullif(m["year"], F.lit(0))), lambda y: y.isNotNull())
    out = out.withColumn("year_start", F.when(changed, F.array_min(years)).otherwise(F.col("year_start"))).withColumn("year_end", F.when(changed, F.array_max(years)).otherwise(F.col("year_end")))
    return out.select(nodes.columns), edges.where(~both).unionByName(rewire(edges.where(both), src, dst))


def merge_targets(nodes: DataFrame) -> DataFrame:
    """(node_id, into, label): for each node, every other one of its outline that it may be merged into."""
    other = nodes.select(F.col("node_id").alias("into"), "label")
    # One outline's nodes, a few hundred: their pairs are what is asked for, kept in one array a node.
    every = other.agg(F.array_sort(F.collect_list(F.struct("into", "label")))).scalar()
    listed = nodes.select("node_id", every.alias("all")).select("node_id", F.explode(F.filter("all", lambda o: o["into"] != F.col("node_id"))).alias("o"))
    return listed.select("node_id", "o.into", "o.label")


def rename(nodes: DataFrame, node: str, label: str) -> DataFrame:
    """An empty label changes nothing."""
    label = label.strip()
    return nodes.withColumn("label", F.when((F.col("node_id") == node) & F.lit(bool(label)), F.lit(label)).otherwise(F.col("label")))


def delete_node(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """C4: the node and every edge that touches it."""
    return nodes.where(F.col("node_id") != node), edges.where((F.col("source_node") != node) & (F.col("target_node") != node))


def delete_edge(edges: DataFrame, edge: int) -> DataFrame:
    """An unknown id changes nothing."""
    return edges.where(F.col("id") != edge)


def reclassify(edges: DataFrame, edge: int, kind: str) -> DataFrame:
    """Only to one of EDGE_TYPES."""
    if kind not in EDGE_TYPES:
        raise ValueError(f"{kind!r} is no edge type")
    return edges.withColumn("edge_type", F.when(F.col("id") == edge, F.lit(kind)).otherwise(F.col("edge_type")))


def record(edits: Column, op: str, detail: str, at: datetime, by: str | None = None) -> Column:
    """The audit with one more entry; detail is JSON."""
    entry = F.struct(F.lit(op).alias("op"), F.lit(detail).alias("detail"), F.lit(at).cast("timestamp").alias("at"), F.lit(by).cast("string").alias("by"))
    return F.array_append(F.coalesce(edits, F.expr(f"cast(array() as array<{EDIT}>)")), entry)


def delete_genealogy(genealogies: DataFrame, edges: DataFrame, requests: DataFrame, genealogy: int, typed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Only when its concept was typed: the row and its edges go, requests lose their link to it."""
    hit = genealogies.where((F.col("id") == genealogy) & (F.col("concept") == typed)).select(F.col("id").alias("genealogy_id"))
    kept = genealogies.join(hit.select(F.col("genealogy_id").alias("id")), "id", "left_anti")
    linked = requests.join(hit.withColumn("_gone", F.lit(True)), "genealogy_id", "left")
    cleared = linked.withColumn("genealogy_id", F.when(F.col("_gone").isNull(), F.col("genealogy_id"))).select(requests.columns)
    return kept, edges.join(hit, "genealogy_id", "left_anti").select(edges.columns), cleared


def listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their number of edge ends and whether they are isolated."""
    ends = edges.select(F.explode(F.array("source_node", "target_node")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("ends"))
    counted = nodes.join(ends, "node_id", "left").withColumn("ends", F.coalesce("ends", F.lit(0)))
    return counted.withColumn("isolated", F.col("ends") == 0)
