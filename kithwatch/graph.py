"""The two tables every operator works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.functions.expressions import high_end, low_end


@dataclass(frozen=True)
class Graph:
    """An undirected attributed graph.

    ``nodes`` has one row per node, keyed by ``id``. ``edges`` has one row per linked
    pair, ``src`` being the smaller end, plus any edge attributes.
    """

    nodes: DataFrame
    edges: DataFrame


def canonical_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected edges of a table of pairs, self-loops left out."""
    return (
        pairs.where(F.col(left) != F.col(right))
        .select(low_end(left, right).alias("src"), high_end(left, right).alias("dst"))
        .distinct()
    )


def both_directions(edges: DataFrame, *keep: str, loops_twice: bool = False) -> DataFrame:
    """Each edge as ``(node, neighbor)`` seen from either end.

    A self-loop makes its node a neighbour of itself once; with ``loops_twice`` it gives
    two rows, which is how it counts towards the degree.
    """
    back = edges if loops_twice else edges.where(F.col("src") != F.col("dst"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), *keep).unionByName(
        back.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), *keep)
    )
