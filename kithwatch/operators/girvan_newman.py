"""Edge betweenness and the first Girvan-Newman split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kithwatch.graph import both_directions
from kithwatch.operators.components import connected_components
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import dense_ids, hot_keys, lookup

#: Rows ``(source, node)`` that are searched for at once, at most about.
BATCH_ROWS = 2_000_000_000


def edge_betweenness(
    nodes: DataFrame, edges: DataFrame, batch_rows: int = BATCH_ROWS, parts: DataFrame | None = None
) -> DataFrame:
    """``(src, dst, betweenness)``: shortest paths over each edge, unweighted and exact.

    Brandes (2001, 2008) for many sources at once: a breadth-first search whose rows are
    ``(source, node, paths)``, one table per distance, then a pass back that hands each
    node's share of the paths to the edges it was reached by. The work is nodes times
    edges, spread over the sources; a search from some of the sources would be cheaper but
    not exact.

    Nodes that hang on the rest by one edge are folded into their neighbour first, again and
    again: such an edge carries a path for every pair of nodes it parts, which takes no search.
    What is left is searched with each node standing for those folded into it, so that nodes and
    edges above are those on circles and between them. ``parts`` gives the components
    ``(id, component)`` of the nodes of all edges, if the caller has them.

    Sources are taken in batches by a hash, so that no more than about ``batch_rows`` rows of
    distances are on disk; they are dropped when what the batch sends over the edges has been
    added to the one table of all batches. Every plan reads a few tables, however many
    distances and batches there are.
    """
    scratch = Scratch(edges.sparkSession, "betweenness")
    flows = scratch.add(edges.select("src", "dst", F.lit(0.0).alias("flow")), "flows")
    ends, weights, rows = _fold(nodes, edges, scratch, parts)
    fans = ends.groupBy("node").agg(F.count(F.lit(1)).alias("fan"))
    near = lookup(ends, fans.withColumnRenamed("node", "neighbor"), "neighbor", ["node"], rows=rows)
    links = scratch.save(lookup(near, weights.select("node", "ends"), "node", ["neighbor"], rows=rows), "links")
    # A node without links reaches nothing.
    linked = weights.where("starts > 0").join(fans, "node").select(F.col("node").alias("id"), "fan", "starts")
    sources = scratch.save(linked, "sources")
    count = sources.count()
    batches = max(1, min(count, -(-count * count // batch_rows)))
    for number in range(batches):
        mine = sources.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == number) if batches > 1 else sources
        spreads = _search(mine, links, scratch)
        if len(spreads) > 2:
            scratch.add(_hand_back(mine, links, scratch, spreads), "flows")
        scratch.drop("batch")
    scratch.drop("sources")
    scratch.drop("links")
    scratch.drop("fold")
    # Every path was followed from either end.
    return scratch.table("flows").groupBy("src", "dst").agg((F.sum("flow") / 2).alias("betweenness"))


def _fold(
    nodes: DataFrame, edges: DataFrame, scratch: Scratch, parts: DataFrame | None
) -> tuple[DataFrame, DataFrame, int]:
    """Links and weights of the nodes that are left when those with one link are folded away.

    Weights are ``(node, starts, ends)``: how many nodes of the table, and how many in all, a node
    stands for. What goes over the edges of folded nodes is added to the flows. A tree goes down to
    one node; a round takes a step off every branch, so there are no more of them than a search
    from the tip of the longest would take.
    """
    ends = scratch.save(both_directions(edges.where(F.col("src") != F.col("dst"))), "fold/ends-0")
    rows = ends.count()
    known = nodes.select(F.col("id").alias("node")).distinct().withColumn("starts", F.lit(1.0))
    linked = ends.select("node").distinct().join(known, "node", "left")
    linked = linked.select("node", F.coalesce("starts", F.lit(0.0)).alias("starts"), F.lit(1.0).alias("ends"))
    weights = everyone = scratch.save(linked, "fold/weights-0")
    depth = 0
    while rows:
        fans = ends.groupBy("node").agg(F.count(F.lit(1)).alias("fan"), F.min("neighbor").alias("neighbor"))
        fans = scratch.save(fans, f"fold/fans-{depth}")
        tips = fans.where(F.col("fan") == 1).select("node", "neighbor")
        above = fans.where(F.col("fan") > 1).select(F.col("node").alias("neighbor"), F.lit(True).alias("goes_on"))
        # Of two nodes that have only each other the smaller stays.
        tips = tips.join(above, "neighbor", "left").where(F.col("goes_on") | (F.col("node") > F.col("neighbor")))
        folded = tips.select("node", "neighbor").join(weights, "node")
        folded = scratch.save(folded.select("node", "neighbor", "starts", "ends"), f"fold/tips/{depth}")
        if folded.isEmpty():
            scratch.drop(f"fold/tips/{depth}")
            break
        gone = folded.select("node")
        moved = folded.select(F.col("neighbor").alias("node"), "starts", "ends")
        left = weights.unionByName(moved).groupBy("node").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
        weights = scratch.save(left.join(gone, "node", "left_anti"), f"fold/weights-{depth + 1}")
        # A folded node has one link, so neither end of what is left is gone.
        kept = ends.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "neighbor"), "neighbor", "left_anti")
        ends = scratch.save(kept.select("node", "neighbor"), f"fold/ends-{depth + 1}")
        rows = ends.count()
        for name in ("ends", "fans", *(["weights"] if depth else [])):
            scratch.drop(f"fold/{name}-{depth}")
        depth += 1
    if depth:
        scratch.add(_over_folded(everyone, edges, scratch, parts), "flows")
    return ends, weights, rows


def _over_folded(everyone: DataFrame, edges: DataFrame, scratch: Scratch, parts: DataFrame | None) -> DataFrame:
    """``(src, dst, flow)``: every folded edge carries the pairs of nodes on either side of it, both ways."""
    if parts is None:
        pairs = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
        parts = scratch.save(connected_components(everyone.select(F.col("node").alias("id")), pairs), "fold/parts")
    parts = parts.withColumnRenamed("id", "node")
    totals = everyone.join(parts, "node").groupBy("component")
    totals = totals.agg(F.sum("starts").alias("all_starts"), F.sum("ends").alias("all_ends"))
    placed = scratch.every("fold/tips").join(parts, "node")
    inward = (F.col("all_starts") - F.col("starts")) * F.col("ends")
    outward = F.col("starts") * (F.col("all_ends") - F.col("ends"))
    return lookup(placed, totals, "component", ["node"]).select(
        F.least("node", "neighbor").alias("src"), F.greatest("node", "neighbor").alias("dst"), (inward + outward).alias("flow")
    )


def _search(sources: DataFrame, links: DataFrame, scratch: Scratch) -> list[int]:
    """Write the nodes at each distance from the sources with the number of shortest paths.

    Gives the rows that each distance makes at the neighbours of its nodes; the last is 0.
    """
    level = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths"), "fan")
    spreads = [_store(level, scratch, 0)]
    while spreads[-1]:
        depth = len(spreads) - 1
        level = scratch.table(f"batch/level-{depth}")
        # A neighbour of a level lies in it, just before it or just after it.
        near = level.unionByName(scratch.table(f"batch/level-{depth - 1}")) if depth else level
        reached = _spread(level, links, spreads[-1]).select(
            "source", F.col("neighbor").alias("node"), "paths", F.col("next_fan").alias("fan"), F.lit(False).alias("seen")
        )
        fresh = (
            reached.unionByName(near.withColumn("seen", F.lit(True)))
            .groupBy("source", "node")
            .agg(F.sum("paths").alias("paths"), F.max("fan").alias("fan"), F.max("seen").alias("seen"))
            .where(~F.col("seen"))
            .drop("seen")
        )
        spreads.append(_store(fresh, scratch, depth + 1))
    return spreads


def _store(level: DataFrame, scratch: Scratch, depth: int) -> int:
    seen = Observation()
    scratch.save(level.observe(seen, F.sum("fan").alias("rows")), f"batch/level-{depth}")
    return seen.get["rows"] or 0


def _hand_back(sources: DataFrame, links: DataFrame, scratch: Scratch, spreads: list[int]) -> DataFrame:
    """``(src, dst, flow)`` of a batch, from the farthest nodes back to the sources."""
    shares = None
    for depth in range(len(spreads) - 2, 0, -1):
        level = scratch.table(f"batch/level-{depth}")
        if shares is None:
            level = level.withColumn("share", F.lit(0.0))
        else:
            level = level.join(shares, ["source", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        handed = _spread(level, links, spreads[depth])
        handed = handed.withColumn("paths", (F.col("ends") + F.col("share")) / F.col("paths"))
        before = scratch.table(f"batch/level-{depth - 1}")
        before = before.select("source", F.col("node").alias("neighbor"), F.col("paths").alias("ways"))
        flow = handed.join(before, ["source", "neighbor"]).select(
            "source", "node", "neighbor", (F.col("paths") * F.col("ways")).alias("flow")
        )
        flow = scratch.save(flow, f"batch/flow/{depth}")
        shares = flow.groupBy("source", F.col("neighbor").alias("node")).agg(F.sum("flow").alias("share"))
    starts = sources.select(F.col("id").alias("source"), "starts")
    return (
        scratch.every("batch/flow")
        .join(starts, "source")
        .withColumn("flow", F.col("flow") * F.col("starts"))
        .groupBy(F.least("node", "neighbor").alias("src"), F.greatest("node", "neighbor").alias("dst"))
        .agg(F.sum("flow").alias("flow"))
    )


def _spread(level: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """Each row of a level at every neighbour of its node, the rows of a hub split up."""
    hot = hot_keys(level, ["node"], F.col("fan"))
    onward = links.select("node", "neighbor", "ends", F.col("fan").alias("next_fan"))
    return lookup(level.drop("fan"), onward, "node", ["source"], rows=rows, hot=hot)


def girvan_newman_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, community)`` after the first split.

    The edge of highest betweenness (the smallest pair among equals) is removed until there
    are more components than at the start. A graph without edges is left as it is.

    Paths do not leave a component, so a removal changes nothing outside the component that
    held the edge: only that one is searched again, the betweenness of all others is kept.
    """
    scratch = Scratch(edges.sparkSession, "girvan-newman")
    parts = scratch.save(connected_components(nodes, edges), "parts")
    named = parts.select(F.col("id").alias("src"), "component")
    scores = lookup(edge_betweenness(nodes, edges), named, "src", ["dst"])
    scores = scratch.save(scores.select("src", "dst", "betweenness", "component"), "scores-0")
    removed = 0
    while True:
        top = scores.orderBy(F.desc(F.round("betweenness", 6)), "src", "dst").first()
        if top is None:
            break
        removed += 1
        held = F.col("component") == F.lit(top.component)
        taken = (F.col("src") == F.lit(top.src)) & (F.col("dst") == F.lit(top.dst))
        rest = scratch.save(scores.where(held & ~taken).select("src", "dst"), f"rest-{removed}")
        members = parts.where(held).select("id")
        with Scratch(edges.sparkSession, "parts"):
            split = scratch.save(connected_components(members, rest), f"split-{removed}")
        if _count(split) > 1:
            parts = scratch.save(parts.where(~held).unionByName(split), "placed")
            break
        with Scratch(edges.sparkSession, "again"):
            # All that is linked here is one component, nodes that the table does not list included.
            linked = members.unionByName(rest.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
            whole = linked.withColumn("component", F.lit(top.component))
            again = edge_betweenness(members, rest, parts=whole).withColumn("component", F.lit(top.component))
            scores = scratch.save(scores.where(~held).unionByName(again), f"scores-{removed}")
        for name in ("rest", "split"):
            scratch.drop(f"{name}-{removed}")
        scratch.drop(f"scores-{removed - 1}")
    names = parts.where(F.col("id") == F.col("component")).select("component")
    ids = dense_ids(names, "component", "community", scratch, "names")
    found = lookup(parts, ids, "component", ["id"], rows=parts.count())
    return found.select(F.col("id").alias("node"), "community")


def _count(parts: DataFrame) -> int:
    return parts.where(F.col("id") == F.col("component")).count()
