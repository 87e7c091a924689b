"""Neighbourhood metrics of nodes against a partition into communities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.graph import both_directions
from kithwatch.operators.skew import lookup

# The metric names callers ask for.
DEGREE = "degree"
INNER = "innerCommunityEdgesAmount"
OUTER = "outerCommunityEdgesAmount"
VECTOR = "neighborsCommunityVector"
COMMUNITY = "community"
METRICS = (DEGREE, INNER, OUTER, VECTOR, COMMUNITY)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree)`` for every node; a self-loop counts twice, an isolated node is 0."""
    ends = both_directions(edges, loops_twice=True)
    counted = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(
        counted.withColumnRenamed("node", "id"), "id", "left"
    ).select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbor_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``(node, community, count)``: neighbours of each node by the neighbour's community.

    Neighbours without a community are not counted.
    """
    labels = communities.select(F.col("node").alias("neighbor"), "community")
    return (
        lookup(both_directions(edges), labels, "neighbor", ["node"], rows=2 * edges.count())
        .groupBy("node", "community")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def neighborhoods(edges: DataFrame, communities: DataFrame, vector: bool = False) -> DataFrame:
    """``(node, member, community, degree, inner, outer, total, largest)`` of all nodes with a link or a community.

    One look-up of the neighbours' communities feeds all metrics. A node's own community comes
    in as one more row of the count by community, so that links inside need no second join.
    ``inner`` and ``outer`` split the neighbours that have a community by own and other,
    ``total`` counts them all and ``largest`` those in the best represented one. ``member``
    says whether the node is in the table of communities; ``vector`` adds its counts as a map.
    """
    loop = F.col("src") == F.col("dst")
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.when(loop, 2).otherwise(1).alias("ends"))
    back = edges.where(~loop).select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), F.lit(1).alias("ends"))
    labels = communities.select(F.col("node").alias("neighbor"), "community")
    seen = lookup(forward.unionByName(back), labels, "neighbor", ["node"], how="left", rows=2 * edges.count())
    own = communities.select("node", "community", F.lit(0).alias("links"), F.lit(0).alias("ends"), F.lit(True).alias("own"))
    near = (
        seen.select("node", "community", F.lit(1).alias("links"), "ends", F.lit(False).alias("own"))
        .unionByName(own)
        .groupBy("node", "community")
        .agg(F.sum("links").alias("links"), F.sum("ends").alias("ends"), F.max("own").alias("own"))
    )
    known = F.col("community").isNotNull()
    counts = F.collect_list(F.when(known & (F.col("links") > 0), F.struct("community", F.col("links").alias("count"))))
    return (
        near.groupBy("node")
        .agg(
            F.max("own").alias("member"),
            F.max(F.when(F.col("own"), F.col("community"))).alias("community"),
            F.sum("ends").alias("degree"),
            F.sum(F.when(known & F.col("own"), F.col("links")).otherwise(0)).alias("inner"),
            F.sum(F.when(known, F.col("links")).otherwise(0)).alias("total"),
            F.max(F.when(known, F.col("links")).otherwise(0)).alias("largest"),
            *([F.map_from_entries(counts).alias("vector")] if vector else []),
        )
        .withColumn("outer", F.col("total") - F.col("inner"))
    )


def community_vectors(edges: DataFrame, communities: DataFrame, width: int | None = None) -> DataFrame:
    """``(node, vector)``: neighbour counts as a sparse map, or dense with a ``width``.

    A vector is as long as the node's neighbours have communities. The long form of
    :func:`neighbor_communities` carries the same counts without wide cells.
    """
    pairs = F.collect_list(F.struct("community", "count"))
    sparse = (
        neighbor_communities(edges, communities)
        .groupBy("node")
        .agg(F.map_from_entries(pairs).alias("vector"))
    )
    if width is None:
        return sparse
    every = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    none = F.lit(0).cast("long")
    dense = F.transform(every, lambda community: F.coalesce(F.try_element_at("vector", community), none))
    return sparse.withColumn("vector", dense)


def missing_metrics(nodes: DataFrame, wanted: Iterable[str] | None) -> list[str]:
    """The wanted metrics that are known and not yet a column of the nodes."""
    return [name for name in METRICS if name in set(wanted or ()) and name not in nodes.columns]


def with_metrics(
    nodes: DataFrame,
    edges: DataFrame,
    communities: DataFrame,
    wanted: Iterable[str] | None,
    vector_width: int | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Add the wanted metric columns to the nodes, leaving those they already have.

    The neighbour vector is a map, or an array of ``vector_width`` counts. ``near`` are the
    :func:`neighborhoods` of the graph, with vectors if they are wanted, where the caller has them.
    """
    todo = missing_metrics(nodes, wanted)
    if not todo:
        return nodes
    if near is None:
        if todo == [COMMUNITY]:
            near = communities.select("node", "community")
        elif todo == [DEGREE]:
            near = degrees(nodes, edges).withColumnRenamed("id", "node")
        else:
            near = neighborhoods(edges, communities, VECTOR in todo)
    none = F.lit(0).cast("long")

    sparse = F.coalesce("_near.vector", F.create_map().cast("map<bigint,bigint>")) if VECTOR in todo else none
    counts = sparse
    if VECTOR in todo and vector_width is not None:
        every = F.sequence(none, F.lit(vector_width - 1).cast("long"))
        counts = F.transform(every, lambda community: F.coalesce(F.try_element_at(sparse, community), none))
    made = {
        DEGREE: lambda: F.coalesce("_near.degree", none),
        INNER: lambda: F.coalesce("_near.inner", none),
        OUTER: lambda: F.coalesce("_near.outer", none),
        VECTOR: lambda: counts,
        COMMUNITY: lambda: F.col("_near.community"),
    }
    # One column to join, so that no name of the nodes can clash.
    found = near.select(F.col("node").alias("id"), F.struct(*(c for c in near.columns if c != "node")).alias("_near"))
    return nodes.join(found, "id", "left").select(
        *(F.col(f"`{name}`") for name in nodes.columns), *(made[name]().alias(name) for name in todo)
    )
