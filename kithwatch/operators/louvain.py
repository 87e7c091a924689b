"""Louvain communities with synchronous, damped moves.

Blondel, Guillaume, Lambiotte, Lefebvre: "Fast unfolding of communities in large networks"
(2008). Nodes cannot move one after the other on a cluster, and letting all of them move at
once makes neighbours swap places for ever. So a seeded hash holds a part of the nodes back
in each round, and the best labelling seen is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kithwatch.operators.components import component_roots
from kithwatch.operators.modularity import weighted
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import dense_ids, lookup, pieces_of

# Fixed value: an improvement of the modularity below this is none.
LEAST_GAIN = 1e-7
# Rounds over which the modularity must grow for a level to go on.
PATIENCE = 3


@dataclass
class _Level:
    """A (contracted) graph: links in both directions, and per node its loop and strength."""

    links: DataFrame  # u, v, w, and the strength k of u
    nodes: DataFrame  # u, loop, k, fan, and the weight of the lightest link
    hubs: DataFrame  # u, _pieces
    rows: int  # number of links
    members: int  # number of nodes
    double_m: float
    settled: float = 0.0  # what settled components, which are not listed, add to the modularity


def _level(scratch: Scratch, name: str, links: DataFrame, loops: DataFrame) -> _Level:
    """``links`` lists both directions; ``loops`` has one row ``(u, loop)`` per node."""
    strength = links.groupBy("u").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("fan"), F.min("w").alias("lightest"))
    nodes = scratch.save(
        loops.join(strength, "u", "left").select(
            "u",
            "loop",
            (F.coalesce("out", F.lit(0.0)) + 2 * F.col("loop")).alias("k"),
            F.coalesce("fan", F.lit(0)).alias("fan"),
            "lightest",
        ),
        f"{name}-nodes",
    )
    hubs = pieces_of(nodes, "u", "fan")
    sums = nodes.agg(
        F.sum("fan").alias("rows"), F.count(F.lit(1)).alias("members"), F.sum("k").alias("double_m")
    ).first()
    rows = sums.rows or 0
    strong = lookup(links, nodes.select("u", "k"), "u", ["v"], rows=rows, hot=hubs)
    links = scratch.save(strong.select("u", "v", "w", "k"), f"{name}-links")
    return _Level(links, nodes, hubs, rows, sums.members, sums.double_m or 0.0)


def _round(level: _Level, labels: DataFrame, seed: int, number: int, share: float) -> DataFrame:
    """Move a part of the nodes; ``was``, ``inner`` and ``own_tot`` describe the labelling before.

    Every node lists the communities of its neighbours, and its own in any case. The gain of
    each is known once the totals of the communities are, and one aggregate per node then
    finds the best and what staying is worth. Of two nodes that are alone only the larger
    may join the other, or they would swap places.
    """
    totals = labels.groupBy("c").agg(
        F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"), F.sum(F.col("fan") + 1).alias("listed")
    )
    # A community is listed at most once for each link of its members, and by each of them.
    busy = pieces_of(totals, "c", "listed")
    nothing = F.lit(None)
    near = lookup(
        level.links,
        labels.select(F.col("u").alias("v"), "c"),
        "v",
        ["u"],
        rows=level.rows,
        hot=level.hubs.withColumnRenamed("u", "v"),
    ).select("u", "c", "w", "k", "v", nothing.cast("double").alias("loop"), nothing.cast("bigint").alias("fan"))
    own_rows = labels.select("u", "c", F.lit(0.0).alias("w"), "k", nothing.cast("bigint").alias("v"), "loop", "fan")
    listed = (
        near.unionByName(own_rows)
        .groupBy("u", "c")
        .agg(F.sum("w").alias("w"), *(F.max(name).alias(name) for name in ("k", "v", "loop", "fan")))
    )
    options = lookup(
        listed,
        totals.select("c", "tot", "members"),
        "c",
        ["u"],
        rows=level.rows + level.members,
        hot=busy,
    ).withColumn("own", F.col("loop").isNotNull())
    others = F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - F.col("k") * others / level.double_m
    option = F.struct(gain.alias("gain"), (-F.col("c")).alias("place"))
    upward = ~F.col("own") & (F.col("members") == 1) & (F.col("v") > F.col("u"))

    def of_own(value) -> Column:
        return F.max(F.when(F.col("own"), value))

    judged = options.groupBy("u").agg(
        F.max(option).alias("any"),
        F.max(F.when(~upward, option)).alias("downward"),
        of_own(gain).alias("staying"),
        of_own(F.col("c")).alias("was"),
        of_own(F.col("w")).alias("inner"),
        of_own(F.col("tot")).alias("own_tot"),
        of_own(F.col("members")).alias("members"),
        F.max("k").alias("k"),
        F.max("loop").alias("loop"),
        F.max("fan").alias("fan"),
    )
    best = F.when(F.col("members") == 1, F.col("downward")).otherwise(F.col("any"))
    active = F.pmod(F.xxhash64("u", F.lit(seed), F.lit(number)), F.lit(1000)) < int(1000 * share)
    moves = active & (best["gain"] > F.col("staying") + LEAST_GAIN)
    return judged.select(
        "u",
        F.when(moves, -best["place"]).otherwise(F.col("was")).alias("c"),
        "k",
        "loop",
        "fan",
        "was",
        "own_tot",
        "inner",
    )


def _stored(level: _Level, labels: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, float, int]:
    """The labels of a round, the modularity of the labelling before it, and how many nodes it moved.

    The squares of the community totals are summed node by node, each adding its strength
    times the total of its community, so nothing is grouped; the sums are taken as the labels
    are written.
    """
    seen = Observation()
    watched = labels.observe(
        seen,
        F.sum(F.col("inner") + 2 * F.col("loop")).alias("inside"),
        F.sum(F.col("k") * F.col("own_tot")).alias("squares"),
        F.count_if(F.col("c") != F.col("was")).alias("moved"),
    )
    stored, sums = scratch.save(watched, name), seen.get
    quality = level.settled + sums["inside"] / level.double_m - sums["squares"] / level.double_m**2
    return stored, quality, sums["moved"]


def _settle(
    level: _Level, scratch: Scratch, name: str, seed: int, share: float, tolerance: float, max_rounds: int
) -> tuple[DataFrame, float]:
    """Best labelling ``(u, c)`` of a level and its modularity."""
    labels = level.nodes.select("u", F.col("u").alias("c"), "k", "loop", "fan")
    best_round, tops, quiet = 0, [], 0
    best = labels.select("u", "c")
    for number in range(1, max_rounds + 1):
        labels, quality, moved = _stored(level, _round(level, labels, seed, number, share), scratch, f"{name}-{number}")
        if not tops or quality > tops[-1] + LEAST_GAIN:
            if best_round not in (0, number - 1):
                scratch.drop(f"{name}-{best_round}")
            best, best_round = labels.select("u", F.col("was").alias("c")), number
        tops.append(max(quality, tops[-1]) if tops else quality)
        if number - 1 not in (0, best_round):
            scratch.drop(f"{name}-{number - 1}")
        # A round in which nobody moved may only have held back those who would.
        quiet = quiet + 1 if moved == 0 else 0
        stalled = len(tops) > PATIENCE and tops[-1] - tops[-1 - PATIENCE] <= max(LEAST_GAIN, tolerance * abs(tops[-1]))
        if quiet == 2 or stalled:
            return best, tops[-1]
    raise RuntimeError(f"communities not settled after {max_rounds} rounds")


def _settle_light(level: _Level, scratch: Scratch) -> tuple[_Level, DataFrame]:
    """The level without its settled components, and ``(u, c, settled)`` of all nodes.

    Merging two communities a and b that are linked by w gains where ``w > K_a K_b / 2m``. In a
    component of strength K, w is at least the lightest link and ``K_a K_b`` at most ``K^2 / 4``.
    Where that much suffices, every labelling with more than one community there gains by a merge,
    so what Louvain ends with is the whole component, however it comes there. Weights must not be
    negative for that; other components go through the rounds.
    """
    pairs = level.links.where(F.col("u") < F.col("v")).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    roots = component_roots(pairs).withColumnRenamed("node", "u")
    parts = scratch.save(level.nodes.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u")), "parts")
    heaviest = 4 * level.double_m * (F.col("lightest") - LEAST_GAIN)
    alone = F.col("lightest").isNull()
    sums = parts.groupBy("root").agg(
        F.sum("k").alias("strength"), F.min("lightest").alias("lightest"), F.min("loop").alias("least_loop")
    )
    light = (F.col("least_loop") >= 0) & (alone | ((F.col("lightest") > 0) & (F.col("strength") ** 2 < heaviest)))
    sums = scratch.save(sums.select("root", "strength", light.alias("settled")), "strengths")
    known = sums.where("settled").agg(F.sum("strength").alias("inside"), F.sum(F.col("strength") ** 2).alias("squares")).first()
    settled = (known.inside or 0.0) / level.double_m - (known.squares or 0.0) / level.double_m**2
    placed = lookup(parts, sums.select("root", "settled"), "root", ["u"], rows=level.members)
    placed = scratch.save(placed.withColumn("c", F.when(F.col("settled"), F.col("root")).otherwise(F.col("u"))), "places")
    labels = placed.select("u", "c", "settled")
    nodes = placed.where(~F.col("settled")).select(*level.nodes.columns)
    left = nodes.agg(F.sum("fan").alias("rows"), F.count(F.lit(1)).alias("members")).first()
    rows = left.rows or 0
    links = lookup(level.links, nodes.select("u"), "u", ["v"], rows=level.rows, hot=level.hubs)
    links = scratch.save(links.select(*level.links.columns), "open-links") if rows else level.links.limit(0)
    return replace(level, links=links, nodes=nodes, rows=rows, members=left.members, settled=settled), labels


def louvain_communities(
    nodes: DataFrame,
    edges: DataFrame,
    weight: str | None = None,
    seed: int = 7,
    share: float = 0.75,
    tolerance: float = 0.0,
    max_rounds: int = 1000,
    max_levels: int = 100,
) -> DataFrame:
    """``(node, community)`` of every node; isolated nodes are alone.

    ``weight`` names the edge column to use, by default ``weight`` where there is one. In
    each round this ``share`` of the nodes may move. A level ends when nobody moves, or when the
    modularity has not grown in three rounds; a ``tolerance`` above 0 ends it when it has grown by
    less than that, relative to itself. Raises when rounds or levels do not settle. Communities
    are numbered by their smallest node. The same input and seed give the same result. Components
    that can only end as one community, by their strengths and weights, take no part in the rounds.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    ids = scratch.save(dense_ids(nodes.select("id").distinct(), "id", "u", scratch, "ids"), "numbered")
    start = ids.select(F.col("id").alias("src"), "u")
    end = ids.select(F.col("id").alias("dst"), F.col("u").alias("v"))
    rows = edges.count()
    numbered = lookup(weighted(edges, weight), start, "src", ["dst"], rows=rows)
    numbered = lookup(numbered, end, "dst", ["src"], rows=rows)
    numbered = scratch.save(numbered.groupBy("u", "v").agg(F.sum("weight").alias("w")), "edges")
    level = _level(
        scratch,
        "level-0",
        _both_ways(numbered),
        ids.select("u").join(
            numbered.where(F.col("u") == F.col("v")).select("u", F.col("w").alias("own")), "u", "left"
        ).select("u", F.coalesce("own", F.lit(0.0)).alias("loop")),
    )
    placed, fixed = ids.select("id", F.col("u").alias("c")), None
    everyone = level.members
    if math.isfinite(level.double_m) and level.double_m > 0:
        level, labels = _settle_light(level, scratch)
        known = scratch.save(ids.join(labels, "u").select("id", "c", "settled"), "known")
        placed, fixed = (known.where(kind).select("id", "c") for kind in (~F.col("settled"), F.col("settled")))
    quality = float("-inf")
    depth = -1
    while level.double_m and level.members:
        depth += 1
        if depth == max_levels:
            raise RuntimeError(f"communities not settled after {max_levels} levels")
        labels, reached = _settle(
            level, scratch, f"level-{depth}-round", seed + depth, share, tolerance, max_rounds
        )
        if reached <= quality + LEAST_GAIN:
            break
        quality = reached
        merged = labels.select(F.col("u").alias("c"), F.col("c").alias("into"))
        placed = scratch.save(
            lookup(placed, merged, "c", ["id"], rows=everyone).select("id", F.col("into").alias("c")), f"placed-{depth}"
        )
        level = _contract(level, labels, scratch, f"level-{depth + 1}")
    if fixed is not None:
        placed = placed.unionByName(fixed)
    smallest = placed.groupBy("c").agg(F.min("id").alias("first"))
    numbers = dense_ids(smallest.select("first"), "first", "community", scratch, "communities")
    names = scratch.save(smallest.join(numbers, "first").select("c", "community"), "names")
    return lookup(placed, names, "c", ["id"], rows=everyone).select(F.col("id").alias("node"), "community")


def _both_ways(pairs: DataFrame) -> DataFrame:
    apart = pairs.where(F.col("u") != F.col("v"))
    return apart.select("u", "v", "w").unionByName(
        apart.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    ).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _contract(level: _Level, labels: DataFrame, scratch: Scratch, name: str) -> _Level:
    """The graph whose nodes are the communities of a labelling."""
    start = labels.select("u", F.col("c").alias("cu"))
    end = labels.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    hubs = level.hubs
    joined = lookup(level.links.drop("k"), start, "u", ["v"], rows=level.rows, hot=hubs)
    joined = lookup(joined, end, "v", ["u"], rows=level.rows, hot=hubs.withColumnRenamed("u", "v"))
    between = scratch.save(joined.groupBy("cu", "cv").agg(F.sum("w").alias("w")), f"{name}-between")
    inside = between.where(F.col("cu") == F.col("cv")).select(F.col("cu").alias("u"), (F.col("w") / 2).alias("loop"))
    kept = level.nodes.join(start, "u").select(F.col("cu").alias("u"), "loop")
    loops = kept.unionByName(inside).groupBy("u").agg(F.sum("loop").alias("loop"))
    links = between.where(F.col("cu") != F.col("cv")).select(F.col("cu").alias("u"), F.col("cv").alias("v"), "w")
    # Settled components keep their share of the total, which no merge changes.
    return replace(_level(scratch, name, links, loops), double_m=level.double_m, settled=level.settled)
