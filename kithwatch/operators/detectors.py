"""Anomaly detectors over node metrics, a partition and node attributes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.features import attribute_columns, feature_table, keep_features, with_community
from kithwatch.operators.glance import glance_scores
from kithwatch.operators.metrics import degrees, neighborhoods, with_metrics
from kithwatch.operators.skew import lookup

_MOMENTS = ("n", "total", "squares")


def _moments(value: str) -> list[Column]:
    """Count, sum and sum of squares of a whole number, all exact."""
    number = F.col(value).cast("decimal(19,0)")
    return [
        F.count(F.lit(1)).cast("decimal(19,0)").alias("n"),
        F.sum(number).cast("decimal(19,0)").alias("total"),
        F.sum((number * number).cast("decimal(38,0)")).cast("decimal(38,0)").alias("squares"),
    ]


def _deviates(value: str, threshold: float, n: Column, total: Column, squares: Column) -> Column:
    """``abs(value - mean) > threshold * std`` with the population deviation.

    Both sides are multiplied by n, which leaves whole numbers to compare: a value exactly
    at the limit is not an anomaly, however the sums were split over tasks.
    """
    distance = F.abs(n * F.col(value).cast("decimal(19,0)") - total).cast("double")
    spread = F.sqrt((n * squares - (total * total).cast("decimal(38,0)")).cast("double"))
    return distance > F.lit(float(threshold)) * spread


def degree_anomalies(
    nodes: DataFrame, edges: DataFrame, threshold: float = 2.0, near: DataFrame | None = None
) -> DataFrame:
    """``(node, degree)`` of nodes whose degree is far from the mean degree."""
    counted = degrees(nodes, edges) if near is None else with_metrics(nodes.select("id"), edges, near, ["degree"], near=near)
    moments = counted.agg(*_moments("degree")).select(F.struct(*_MOMENTS)).scalar()
    return counted.where(
        _deviates("degree", threshold, *(moments.getField(name) for name in _MOMENTS))
    ).select(F.col("id").alias("node"), "degree")


def _member_links(edges: DataFrame, communities: DataFrame, near: DataFrame | None) -> DataFrame:
    """Link counts of every member of a community, 0 where it has no counted neighbour."""
    return (neighborhoods(edges, communities) if near is None else near).where("member")


def within_community_anomalies(
    edges: DataFrame,
    communities: DataFrame,
    threshold: float = 2.0,
    keep_empty: bool = False,
    near: DataFrame | None = None,
) -> DataFrame:
    """``(community, node)`` of members with unusually few or many links inside.

    With ``keep_empty`` a community without anomaly gives one row with a null node. ``near``,
    here and below, are the :func:`~kithwatch.operators.metrics.neighborhoods` of the graph,
    where the caller has them.
    """
    members = _member_links(edges, communities, near).select("node", "community", "inner")
    moments = members.groupBy("community").agg(*_moments("inner"))
    found = (
        lookup(members, moments, "community", ["node"], rows=communities.count())
        .where(_deviates("inner", threshold, *(F.col(name) for name in _MOMENTS)))
        .select("community", "node")
    )
    if keep_empty:
        found = communities.select("community").distinct().join(found, "community", "left")
    return found


def cada_scores(edges: DataFrame, communities: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: counted neighbours over those in the best represented community."""
    return _member_links(edges, communities, near).select(
        "node", F.when(F.col("largest") > 0, F.col("total") / F.col("largest")).otherwise(0.0).alias("score")
    )


def pseudo_cada_scores(edges: DataFrame, communities: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: links out of the community over links inside, infinite without any."""
    return _member_links(edges, communities, near).select(
        "node", F.when(F.col("inner") > 0, F.col("outer") / F.col("inner")).otherwise(float("inf")).alias("score")
    )


def glance(
    nodes: DataFrame,
    communities: DataFrame,
    attributes: Iterable[str] | None = None,
    selected: Iterable[tuple[str, int]] | None = None,
) -> DataFrame:
    """``(node, score)`` of every community member by attribute distance.

    ``attributes`` limits the columns, ``selected`` the features (attribute and position)
    that are scored; nothing selected means all.
    """
    selected = list(selected or ())
    if selected:
        attributes = sorted({attr for attr, _ in selected})
    names = attribute_columns(nodes) if attributes is None else list(attributes)
    if not names:
        return communities.select("node", F.lit(0.0).alias("score"))
    features = feature_table(with_community(nodes.select("id", *names), communities), names)
    return glance_scores(keep_features(features, selected) if selected else features)


def above(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores strictly beyond a threshold."""
    return scores.where(F.col("score") > threshold)
