"""Attribute-distance scores of nodes within their community.

A node stands out in an attribute when many members of its community are farther from its
value than two members are on average. Neither the average nor the counts compare pairs:
both follow from running totals over sorted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup, running_total

CELL = ["community", "attr", "idx"]
# The ends of 64-bit whole numbers.
LEAST, LARGEST = -(2**63), 2**63 - 1

# Places of a row among equal keys: what lies below a value, the value, what it reaches.
_BELOW, _VALUE, _REACH = 0, 1, 2


def _distinct_values(features: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct values of each community and feature with the number of nodes at each."""
    compressed = features.groupBy(*CELL, "value", "whole", "exact").agg(F.count(F.lit(1)).alias("nodes"))
    return scratch.save(compressed, "values")


def _sizes(values: DataFrame) -> tuple[int, int]:
    """Most values of one community and feature, and the feature rows in all."""
    cells = values.groupBy(*CELL).agg(F.count(F.lit(1)).alias("values"), F.sum("nodes").alias("nodes"))
    row = cells.agg(F.max("values"), F.sum("nodes")).first()
    return row[0] or 0, row[1] or 0


def _exact(value: Column, digits: int) -> Column:
    return value.cast(f"decimal({digits},0)")


def _differences(values: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """Node count ``n``, mean difference of all pairs and the ``reach`` derived from it.

    Where C nodes have values up to x and w nodes have x itself, the ordered pairs differ by
    ``2 * sum(x * w * (2C - w - n))`` in total. For whole numbers the sum is exact, and two
    of them differ by more than the mean just when they do by more than its whole part;
    so values equal to the mean are told apart reliably; they are added and compared as the
    64-bit numbers they are. A value that is not finite leaves its community without mean (NaN),
    as comparing every pair would.
    """
    ranked = running_total(values, CELL, ["value", "exact"], "nodes", "upto", "n", scratch, "ranked", largest)
    infinite = F.isnan("value") | (F.abs("value") == float("inf"))
    balance = 2 * F.col("upto") - F.col("nodes") - F.col("n")
    whole_term = F.when(
        F.col("whole"), _exact(F.col("exact"), 19) * (_exact(F.col("nodes"), 19) * _exact(balance, 19))
    )
    term = F.col("value") * F.col("nodes") * balance
    return (
        ranked.groupBy(*CELL)
        .agg(
            F.first("n").alias("n"),
            F.first("whole").alias("whole"),
            F.max(infinite).alias("infinite"),
            F.sum(_exact(whole_term, 38)).alias("whole_total"),
            F.sum(term).alias("total"),
        )
        .withColumn("pairs", F.col("n").cast("double") * F.col("n"))
        .select(
            *CELL,
            "n",
            F.when(F.col("infinite"), float("nan"))
            .when(F.col("whole"), 2 * F.col("whole_total").cast("double") / F.col("pairs"))
            .otherwise(2 * F.col("total") / F.col("pairs"))
            .alias("mean_difference"),
            F.when(F.col("infinite"), float("nan"))
            .when(~F.col("whole"), 2 * F.col("total") / F.col("pairs"))
            .otherwise(0.0)
            .alias("reach"),
            # At most half of what two values can differ by, so a 64-bit number.
            F.when(F.col("whole"), F.expr("cast(2 * whole_total div (cast(n as decimal(19,0)) * n) as bigint)"))
            .otherwise(0)
            .alias("exact_reach"),
        )
    )


def mean_differences(features: DataFrame) -> DataFrame:
    """``(community, attr, idx, n, mean_difference)`` of labelled features.

    The mean is over all ordered pairs of members, each member with itself included.
    """
    scratch = Scratch(features.sparkSession, "differences")
    values = _distinct_values(features, scratch)
    return _differences(values, _sizes(values)[0], scratch).drop("reach", "exact_reach")


def far_shares(features: DataFrame) -> DataFrame:
    """``(node, attr, idx, share)``: part of the community farther than the mean difference."""
    scratch = Scratch(features.sparkSession, "glance")
    values = _distinct_values(features, scratch)
    shares, rows = value_shares(values, scratch)
    found = lookup(features.drop("whole"), shares, [*CELL, "value", "exact"], ["node"], rows=rows)
    return found.select("node", "attr", "idx", "share")


def value_shares(values: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(community, attr, idx, value, exact, share)`` of a table of distinct values, and the feature rows they stand for.

    ``values`` has the number of ``nodes`` at each value, and is stored.
    """
    largest, rows = _sizes(values)
    cells = scratch.save(_differences(values, largest, scratch), "cells").select(*CELL, "n", "reach", "exact_reach")
    placed = lookup(values, cells, CELL, ["value", "exact"], rows=rows)
    # Each value marks its own place and the two ends of its reach. The running total at an
    # end counts the nodes before it, ties being settled by the kind of the mark. Whole numbers
    # are placed by their exact value; an end beyond 64 bits lies beyond all of them anyway.
    value, reach = F.col("value"), F.col("reach")
    place = F.when(F.col("whole"), 0.0)
    low = F.coalesce(F.try_subtract("exact", "exact_reach"), F.lit(LEAST))
    high = F.coalesce(F.try_add("exact", "exact_reach"), F.lit(LARGEST))
    none = F.lit(0).cast("long")
    kinds = [
        (low, place.otherwise(value - reach), _BELOW, none),
        (F.col("exact"), place.otherwise(value), _VALUE, F.col("nodes")),
        (high, place.otherwise(value + reach), _REACH, none),
    ]
    marks = placed.select(
        *CELL,
        "value",
        "exact",
        "n",
        "reach",
        F.explode(
            F.array(
                *(
                    F.struct(exact.alias("exact_key"), key.alias("key"), F.lit(kind).alias("kind"), weight.alias("weight"))
                    for exact, key, kind, weight in kinds
                )
            )
        ).alias("mark"),
    ).select(*CELL, "value", "exact", "n", "reach", "mark.*")
    counted = running_total(
        marks, CELL, ["exact_key", "key", "kind"], "weight", "before", "members", scratch, "marks", 3 * largest
    )
    outside = F.sum(
        F.when(F.col("kind") == _BELOW, F.col("before")).when(
            F.col("kind") == _REACH, F.col("members") - F.col("before")
        )
    )
    shares = counted.groupBy(*CELL, "value", "exact", "n", "reach").agg(outside.alias("outside")).select(
        *CELL,
        "value",
        "exact",
        F.when(F.isnan("reach"), 0.0).otherwise(F.col("outside") / F.col("n")).alias("share"),
    )
    return shares, rows


def glance_scores(features: DataFrame) -> DataFrame:
    """``(node, score)``: the largest share over the features of a node."""
    return far_shares(features).groupBy("node").agg(F.max("share").alias("score"))
