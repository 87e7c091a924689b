"""Community detection by name, and tables of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.graph import Graph
from kithwatch.operators.girvan_newman import girvan_newman_communities
from kithwatch.operators.louvain import louvain_communities

METHODS = ("louvain", "girvan_newman")


def detect_communities(graph: Graph, method: str = "louvain", **options) -> DataFrame:
    """``(node, community)`` by the named method."""
    if method == "louvain":
        return louvain_communities(graph.nodes, graph.edges, **options)
    if method == "girvan_newman":
        return girvan_newman_communities(graph.nodes, graph.edges, **options)
    raise ValueError(f"unknown community method {method!r}, expected one of {METHODS}")


def from_lists(lists: DataFrame, position: str, members: str) -> DataFrame:
    """``(node, community)`` of a table with a list of members per community.

    The community is the position of the list; a node named by several lists belongs to the
    last of them.
    """
    return (
        lists.select(F.col(position).cast("long").alias("community"), F.explode(members).alias("node"))
        .groupBy("node")
        .agg(F.max("community").alias("community"))
    )
