"""Modularity of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.skew import lookup


def weighted(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``(src, dst, weight)``: the named column, else a column ``weight``, else 1 per edge."""
    if weight is None and "weight" in edges.columns:
        weight = "weight"
    value = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return edges.select("src", "dst", value.alias("weight"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``(modularity)``: ``sum over communities of in/2m - (tot/2m)^2``.

    ``communities`` must hold every node that has an edge.
    """
    start = communities.select(F.col("node").alias("src"), F.col("community").alias("from"))
    end = communities.select(F.col("node").alias("dst"), F.col("community").alias("to"))
    rows = edges.count()
    labelled = lookup(weighted(edges, weight), start, "src", ["dst"], rows=rows)
    labelled = lookup(labelled, end, "dst", ["src"], rows=rows)
    # Links between the same two communities are added up before anything is regrouped.
    between = labelled.groupBy("from", "to").agg(F.sum("weight").alias("weight"))
    ends = between.select(
        F.explode(F.array("from", "to")).alias("community"),
        "weight",
        F.when(F.col("from") == F.col("to"), F.col("weight")).otherwise(0.0).alias("inside"),
    )
    totals = ends.groupBy("community").agg(F.sum("weight").alias("total"), F.sum("inside").alias("inside"))
    double_m = F.sum("total")
    return totals.agg(
        (F.sum("inside") / double_m - F.sum(F.col("total") * F.col("total")) / (double_m * double_m)).alias(
            "modularity"
        )
    )
