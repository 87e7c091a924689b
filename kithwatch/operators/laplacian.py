"""Laplacian score of features (He, Cai, Niyogi 2005)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup

FEATURE = ["attr", "idx"]
# A spread below the first counts as none and is replaced by the second.
NO_SPREAD = 1e-12
NO_SPREAD_VALUE = 10000.0


def laplacian_score(within: Column, spread: Column) -> Column:
    """Score from the centred ``f'Wf`` and ``f'Df``; NaN where no pair is linked."""
    usable = F.when(spread < NO_SPREAD, F.lit(NO_SPREAD_VALUE)).otherwise(spread)
    return F.coalesce(1 - within / usable, F.lit(float("nan")))


def laplacian_scores(features: DataFrame) -> DataFrame:
    """``(attr, idx, score)`` when nodes are linked exactly within their community.

    ``features`` carries the community of every row. The affinity matrix is never built:
    within a community of n nodes every node has n - 1 links, so both quadratic forms
    follow from the count, mean and sum of squared deviations of each community.
    """
    cells = features.groupBy("community", *FEATURE).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
    )
    links = F.col("n") * (F.col("n") - 1)
    centers = cells.groupBy(*FEATURE).agg(
        F.try_divide(F.sum(links * F.col("mean")), F.sum(links)).alias("center")
    )
    # One row per feature: bounded by the width of the node schema.
    shift = F.col("mean") - F.col("center")
    squares = F.col("n") * F.col("variance")
    return (
        cells.join(F.broadcast(centers), FEATURE)
        .groupBy(*FEATURE)
        .agg(
            F.sum(links * shift * shift - squares).alias("within"),
            F.sum((F.col("n") - 1) * (squares + F.col("n") * shift * shift)).alias("spread"),
        )
        .select(*FEATURE, laplacian_score(F.col("within"), F.col("spread")).alias("score"))
    )


def laplacian_scores_with(features: DataFrame, affinity: DataFrame) -> DataFrame:
    """The same for any affinity ``(i, j, weight)`` between nodes.

    A symmetric affinity lists both directions. Features must cover every node named.
    """
    strength = affinity.groupBy(F.col("i").alias("node")).agg(F.sum("weight").alias("strength"))
    weighted = features.select("node", *FEATURE, "value").join(strength, "node")
    centers = weighted.groupBy(*FEATURE).agg(
        F.try_divide(F.sum(F.col("strength") * F.col("value")), F.sum("strength")).alias("center")
    )
    scratch = Scratch(features.sparkSession, "laplacian")
    # One row per feature, so windows over all of them stay small.
    place = (F.row_number().over(Window.orderBy(*FEATURE)) - 1).alias("place")
    width = F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("width")
    centers = scratch.save(centers.dropna(subset=FEATURE).select(*FEATURE, "center", place, width), "centers")
    nodes = (
        weighted.join(F.broadcast(centers), FEATURE)
        .select("node", "strength", "width", "place", (F.col("value") - F.col("center")).alias("value"))
        .groupBy("node")
        .agg(
            F.max("strength").alias("strength"),
            F.max("width").alias("width"),
            F.collect_list(F.struct("place", "value")).alias("known"),
        )
    )
    everywhere = F.sequence(F.lit(0), F.col("width") - 1)
    missing = F.transform(
        F.array_except(everywhere, F.col("known.place")),
        lambda at: F.struct(at.alias("place"), F.lit(None).cast("double").alias("value")),
    )
    # A map, as no node may have a feature twice.
    whole = F.map_values(F.map_from_entries(F.sort_array(F.concat("known", missing)))).alias("f")
    # A node's features become one array of numbers, which is written, so that they are gathered once.
    vectors = scratch.save(nodes.select("node", "strength", whole), "vectors")
    spread = (
        vectors.select("strength", F.posexplode("f").alias("place", "value"))
        .groupBy("place")
        .agg(F.sum(F.col("strength") * F.col("value") * F.col("value")).alias("spread"))
    )
    rows = affinity.count()
    # An edge is joined once per end, and names of features stay behind.
    left = lookup(affinity, vectors.select(F.col("node").alias("i"), F.col("f").alias("fi")), "i", ["j"], rows=rows)
    both = lookup(left, vectors.select(F.col("node").alias("j"), F.col("f").alias("fj")), "j", ["i"], rows=rows)
    products = F.zip_with("fi", "fj", lambda a, b: F.col("weight") * a * b)
    within = both.select(F.posexplode(products).alias("place", "product")).groupBy("place").agg(F.sum("product").alias("within"))
    return centers.join(spread, "place").join(within, "place", "left").select(
        *FEATURE, laplacian_score(F.col("within"), F.col("spread")).alias("score")
    )


def rank_features(scores: DataFrame, ascending: bool = True) -> DataFrame:
    """Scores with their 0-based ``rank``; ties by feature, NaN and null last.

    One row per feature, so a single window over them stays small.
    """
    known = F.coalesce(F.isnan("score"), F.lit(True)) | F.col("score").isNull()
    best = F.asc("score") if ascending else F.desc("score")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(known, best, *FEATURE)) - 1)
