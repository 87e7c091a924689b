"""Connected components by alternating star contraction.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: "Connected Components in MapReduce
and Beyond" (2014). A large-star step links the larger neighbours of every node to the
smallest node it sees; a small-star step does so for the smaller ones. The edge set turns
into one star per component in a number of rounds that grows with the logarithm of the
data, also on long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kithwatch.graph import both_directions
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import dense_ids, lookup, ordered, stored_if_large


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    smallest = (
        both_directions(edges)
        .groupBy("node")
        .agg(F.min("neighbor").alias("seen"))
        .select(F.col("node").alias("src"), F.least("node", "seen").alias("root"))
    )
    return lookup(edges, smallest, "src", ["dst"], rows=rows).select(F.col("root").alias("src"), "dst")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    smallest = edges.groupBy("dst").agg(F.min("src").alias("root"))
    linked = lookup(edges, smallest, "dst", ["src"], rows=rows)
    return (
        linked.select("root", F.explode(F.array("src", "dst")).alias("node"))
        .where(F.col("root") != F.col("node"))
        .select(F.col("root").alias("src"), F.col("node").alias("dst"))
        .distinct()
    )


def _stored(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges of a round, and number and sum of hashes of what was written, by the same job."""
    ends = F.xxhash64("src", "dst").cast("decimal(20,0)")
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(ends).cast("string").alias("hashes"))
    return scratch.save(watched, name), (seen.get["rows"], seen.get["hashes"])


def _numbered_edges(edges: DataFrame, numbers: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """Edges between numbered nodes: 8 bytes an end, and minima that hash aggregation can take."""
    plain = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    start = numbers.select(F.col("id").alias("src"), F.col("number").alias("a"))
    end = numbers.select(F.col("id").alias("dst"), F.col("number").alias("b"))
    rows = plain.count()
    half = lookup(plain, start, "src", ["dst"], rows=rows).select("a", "dst")
    half = stored_if_large(half, rows, scratch, "half")
    numbered = lookup(half, end, "dst", ["a"], rows=rows)
    stored = _stored(numbered.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), scratch, "round-0")
    scratch.drop("half")
    return stored


def _stars(current: DataFrame, before: tuple, scratch: Scratch, max_rounds: int) -> tuple[DataFrame, int]:
    """One star per component from the edges of round 0, and the number of its edges."""
    done = 0
    while before[0]:
        done += 1
        if done > max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        # A small star has at most two rows for each row of the large star.
        rows = before[0]
        large = stored_if_large(_large_star(current, rows), rows, scratch, "large")
        current, after = _stored(_small_star(large, rows), scratch, f"round-{done}")
        scratch.drop("large")
        scratch.drop(f"round-{done - 1}")
        if after == before:
            break
        before = after
    return current, before[0]


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)``, the component being named after its smallest node.

    A node without edges is a component of its own. Raises when the rounds do not settle.
    """
    scratch = Scratch(edges.sparkSession, "components")
    numbers = ordered(nodes.select("id").distinct(), ["id"], "number", scratch, "numbers")
    current, rows = _stars(*_numbered_edges(edges, numbers, scratch), scratch, max_rounds)
    if not rows:
        return numbers.select("id", F.col("id").alias("component"))
    # Numbers follow the order of the nodes, so the smallest number is the smallest node.
    names = numbers.select(F.col("number").alias("root"), F.col("id").alias("component"))
    stars = current.select(F.col("dst").alias("number"), F.col("src").alias("root"))
    named = lookup(stars, names, "root", ["number"], rows=rows).select("number", "component")
    return numbers.join(named, "number", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_roots(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` of distinct edges between numbers, ``src`` below ``dst``.

    The root is the smallest node of a component; roots themselves have no row.
    """
    scratch = Scratch(edges.sparkSession, "roots")
    stars, _ = _stars(*_stored(edges.select("src", "dst"), scratch, "round-0"), scratch, max_rounds)
    return stars.select(F.col("dst").alias("node"), F.col("src").alias("root"))


def address_users(components: DataFrame) -> DataFrame:
    """``(address, user_id)``: components numbered by their smallest address."""
    scratch = Scratch(components.sparkSession, "users")
    placed = scratch.save(components, "components")
    # The smallest node of a component names it, so the distinct names need no shuffle.
    names = placed.where(F.col("id") == F.col("component")).select("component")
    ids = dense_ids(names, "component", "user_id", scratch, "names")
    found = lookup(placed, ids, "component", ["id"], rows=placed.count())
    return found.select(F.col("id").alias("address"), "user_id")
