"""Scores of an attribute with very many positions, of which a node has few that are not 0.

The neighbour vector has a position for every community. Its rows here are those that are not
0; what is 0 is counted, never written. Both scores come out as if every node had a row for
every position:

* *Laplacian score*: the moments of a community at a position are those of its rows, merged with
  as many zeros as it has other members. Communities without a row there have mean and
  deviation 0; all of them together follow from the totals over all communities.
* *glance*: the zeros of a community at a position are one more distinct value with a count. A
  node whose rows do not name a position has that value there, so its score is at least the
  largest share of a zero among such positions. These are ranked within the community; the
  first rank that the node has no row for is where the ranks of its rows first leave a gap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.glance import CELL, value_shares
from kithwatch.operators.laplacian import FEATURE, laplacian_score
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup, numbered, running_total


@dataclass(frozen=True)
class SparseAttribute:
    """``values`` are ``(node, idx, value)`` without zeros; positions go from 0 to ``width - 1``."""

    name: str
    values: DataFrame
    width: int
    whole: bool = True


def attribute_of_maps(nodes: DataFrame, name: str, width: int) -> SparseAttribute:
    """The attribute that a map column of the nodes holds."""
    entries = nodes.select(F.col("id").alias("node"), F.explode(name).alias("idx", "value"))
    return SparseAttribute(name, entries.where((F.col("value") != 0) & (F.col("idx") < width)), width)


def _rows(attribute: SparseAttribute, communities: DataFrame) -> DataFrame:
    """Rows of community members, as a feature table has them."""
    found = attribute.values.join(communities.select("node", "community"), "node")
    return found.select(
        "node",
        "community",
        F.lit(attribute.name).alias("attr"),
        "idx",
        F.col("value").cast("double").alias("value"),
        F.lit(attribute.whole).alias("whole"),
        (F.col("value").cast("long") if attribute.whole else F.lit(0).cast("long")).alias("exact"),
    )


def _sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("members"))


def sparse_laplacian_scores(attribute: SparseAttribute, communities: DataFrame) -> DataFrame:
    """``(attr, idx, score)`` of every position; ``communities`` hold every node there is."""
    spark = communities.sparkSession
    scratch = Scratch(spark, "sparse-laplacian")
    sizes = scratch.save(_sizes(communities), "sizes")
    n = F.col("members").cast("double")
    links = n * (n - 1)
    all_links = sizes.agg(F.sum(links)).first()[0] or 0.0
    held = _rows(attribute, communities).groupBy("community", *FEATURE).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("value").alias("average"), F.var_pop("value").alias("variance")
    )
    zeros = n - F.col("rows")
    cells = lookup(held, sizes, "community", ["idx"]).select(
        *FEATURE,
        n.alias("n"),
        links.alias("links"),
        (F.col("average") * F.col("rows") / n).alias("mean"),
        # Squared deviations of the rows, and of both means from the common one.
        (F.col("rows") * F.col("variance") + F.col("average") * F.col("average") * F.col("rows") * zeros / n).alias("squares"),
    )
    cells = scratch.save(cells, "cells")
    centers = cells.groupBy(*FEATURE).agg(F.try_divide(F.sum(F.col("links") * F.col("mean")), F.lit(all_links)).alias("center"))
    shift = F.col("mean") - F.col("center")
    rest = (F.lit(all_links) - F.sum("links")) * F.first("center") * F.first("center")
    scored = (
        lookup(cells, centers, FEATURE, ["n", "mean"])
        .groupBy(*FEATURE)
        .agg(
            (F.sum(F.col("links") * shift * shift - F.col("squares")) + rest).alias("within"),
            (F.sum((F.col("n") - 1) * (F.col("squares") + F.col("n") * shift * shift)) + rest).alias("spread"),
        )
        .select(*FEATURE, laplacian_score(F.col("within"), F.col("spread")).alias("score"))
    )
    nothing = F.lit(0.0) if all_links else F.lit(None).cast("double")
    every = spark.range(attribute.width).select(F.lit(attribute.name).alias("attr"), F.col("id").alias("idx"))
    bare = every.join(scored, FEATURE, "left_anti").select(*FEATURE, laplacian_score(nothing, F.lit(0.0)).alias("score"))
    return scored.select("attr", F.col("idx").cast("long").alias("idx"), "score").unionByName(bare)


def ranked_features(scores: DataFrame, ascending: bool = True) -> DataFrame:
    """Scores with their 0-based ``rank``; ties by feature, NaN and null last, for any number of features."""
    scratch = Scratch(scores.sparkSession, "ranked-features")
    unknown = F.coalesce(F.isnan("score"), F.lit(True)) | F.col("score").isNull()
    by = F.when(~unknown, F.col("score") if ascending else -F.col("score"))
    stored = scratch.save(scores.withColumn("_unknown", unknown).withColumn("_by", by), "scores")
    placed = numbered(stored, ["_unknown", "_by", *FEATURE], "rank", scratch, "places")
    return scratch.save(placed.select(*scores.columns, "rank"), "ranked")


def sparse_glance_scores(attribute: SparseAttribute, communities: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """``(node, score)`` of every community member: its largest share over all (or the selected) positions.

    ``selected`` has columns ``attr`` and ``idx``.
    """
    scratch = Scratch(communities.sparkSession, "sparse-glance")
    members = scratch.save(communities.select("node", "community"), "members")
    rows = _rows(attribute, members)
    if selected is not None:
        wanted = selected.where(F.col("attr") == attribute.name).select("idx").distinct()
        rows = rows.join(wanted, "idx", "left_semi")
    rows = scratch.save(rows.select("node", *CELL, "value", "whole", "exact"), "rows")
    distinct = rows.groupBy(*CELL, "value", "whole", "exact").agg(F.count(F.lit(1)).alias("nodes"))
    distinct = scratch.save(distinct, "distinct")
    taken = distinct.groupBy(*CELL, "whole").agg(F.sum("nodes").alias("taken"))
    zeros = lookup(taken, _sizes(members), "community", ["idx"]).select(
        *CELL, F.lit(0.0).alias("value"), "whole", F.lit(0).cast("long").alias("exact"), (F.col("members") - F.col("taken")).alias("nodes")
    )
    values = scratch.save(distinct.unionByName(zeros.where(F.col("nodes") > 0)), "values")
    shares, _ = value_shares(values, scratch)
    shares = scratch.save(shares, "shares")
    own = lookup(rows, shares, [*CELL, "value", "exact"], ["node"]).select("node", "share")
    # Positions where not having a row stands out, the strongest first.
    gaps = shares.where((F.col("value") == 0) & (F.col("share") > 0)).select(
        "community", "idx", "share", (-F.col("share")).alias("_by"), F.lit(1).alias("_one")
    )
    ranked = running_total(gaps, ["community"], ["_by", "idx"], "_one", "rank", "_all", scratch, "ranks")
    ranked = scratch.save(ranked.select("community", "idx", "share", "rank"), "ranked")
    named = lookup(rows.select("node", "community", "idx"), ranked.drop("share"), ["community", "idx"], ["node"])
    named = scratch.save(named.select("node", "rank", F.lit(1).alias("_one")), "named")
    placed = running_total(named, ["node"], ["rank"], "_one", "place", "_all", scratch, "places")
    first = placed.groupBy("node").agg(
        F.coalesce(F.min(F.when(F.col("rank") != F.col("place"), F.col("place"))), F.max("place") + 1).alias("rank")
    )
    free = members.join(first, "node", "left").select("node", "community", F.coalesce("rank", F.lit(1)).alias("rank"))
    bare = lookup(free, ranked.drop("idx"), ["community", "rank"], ["node"], how="left").select("node", F.coalesce("share", F.lit(0.0)).alias("share"))
    return own.unionByName(bare).groupBy("node").agg(F.max("share").alias("score"))
