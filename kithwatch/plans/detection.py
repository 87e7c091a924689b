"""The whole way from a graph to its anomalies."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.graph import Graph
from kithwatch.operators import detectors
from kithwatch.operators.communities import detect_communities
from kithwatch.operators.features import attribute_columns, feature_table, with_community
from kithwatch.operators.laplacian import laplacian_scores
from kithwatch.operators.metrics import METRICS, VECTOR, missing_metrics, neighborhoods, with_metrics
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.sparse_features import (
    SparseAttribute,
    attribute_of_maps,
    ranked_features,
    sparse_glance_scores,
    sparse_laplacian_scores,
)
from kithwatch.operators.spectral import spec_scores
from kithwatch.sources import store

ANOMALY_METHODS = ("degree", "within_communities", "CADA", "pseudo_CADA", "glance")
SELECTION_METHODS = ("laplacian", "spectral")


@dataclass(frozen=True)
class Detection:
    """What a run found; the tables are computed when they are read or written.

    The run stores its input once, and what it works out on the way, in scratch tables of its
    own. ``release`` deletes them when the results have been written, as does the end of a
    ``with`` block.
    """

    anomalies: DataFrame
    scores: DataFrame | None
    communities: DataFrame
    nodes: DataFrame
    #: ``(attr, idx, score, rank)`` of the selected features, a plain number having position -1.
    chosen: DataFrame | None
    scratch: Scratch

    @property
    def selected(self) -> list[tuple[str, int]] | None:
        """The selected features, best first."""
        if self.chosen is None:
            return None
        return [(row.attr, row.idx) for row in self.chosen.orderBy("rank").select("attr", "idx").collect()]

    def save(self, path: str) -> None:
        store.save_anomalies(self.anomalies, path)

    def save_json(self, path: str) -> None:
        store.save_anomalies_json(self.anomalies, path)

    def release(self) -> None:
        self.scratch.drop()

    def __enter__(self) -> Detection:
        return self

    def __exit__(self, *problem) -> None:
        self.release()


def feature_scores(
    nodes: DataFrame,
    communities: DataFrame,
    method: str,
    attributes: Iterable[str] | None = None,
    sparse: SparseAttribute | None = None,
) -> DataFrame:
    """``(attr, idx, score, rank)`` of the features, best first."""
    if method not in SELECTION_METHODS:
        raise ValueError(f"unknown feature selection {method!r}, expected one of {SELECTION_METHODS}")
    numeric = attribute_columns(nodes)
    names = numeric if attributes is None else [a for a in attributes if a in numeric]
    if method == "spectral":
        return ranked_features(spec_scores(nodes, names), ascending=False)
    labelled = with_community(nodes.select("id", *names), communities, how="left")
    scores = laplacian_scores(feature_table(labelled, names)).select("attr", F.col("idx").cast("long").alias("idx"), "score")
    if sparse is not None:
        members = labelled.select(F.col("id").alias("node"), "community")
        scores = scores.unionByName(sparse_laplacian_scores(sparse, members))
    return ranked_features(scores)


def choose_features(
    nodes: DataFrame,
    communities: DataFrame,
    method: str,
    percentile: float = 0.1,
    attributes: Iterable[str] | None = None,
    sparse: SparseAttribute | None = None,
) -> DataFrame:
    """The best ``max(1, int(percentile * count))`` of them."""
    ranked = feature_scores(nodes, communities, method, attributes, sparse)
    return ranked.where(F.col("rank") < max(1, int(ranked.count() * percentile)))


def select_features(
    nodes: DataFrame,
    communities: DataFrame,
    method: str,
    percentile: float = 0.1,
    attributes: Iterable[str] | None = None,
) -> list[tuple[str, int]]:
    """The same as (attribute, position), a plain number having position -1, for plain attributes."""
    best = choose_features(nodes, communities, method, percentile, attributes).orderBy("rank")
    return [(row.attr, row.idx) for row in best.select("attr", "idx").collect()]


def _glance(
    nodes: DataFrame,
    communities: DataFrame,
    wanted: list[str] | None,
    chosen: DataFrame | None,
    sparse: SparseAttribute | None,
) -> DataFrame:
    """Largest share over plain attributes and the sparse one, of the chosen features if any."""
    numeric = attribute_columns(nodes)
    names = None if wanted is None else [a for a in wanted if a in numeric]
    selected, scored = None, []
    if chosen is not None:
        # Those of plain attributes are as few as the columns and their positions.
        plain = chosen if sparse is None else chosen.where(F.col("attr") != sparse.name)
        selected = [(row.attr, row.idx) for row in plain.select("attr", "idx").collect()]
    if sparse is None:
        return detectors.glance(nodes, communities, names or None, selected)
    if selected or (selected is None and names):
        scored.append(detectors.glance(nodes, communities, names, selected))
    members = with_community(nodes.select("id"), communities).select(F.col("id").alias("node"), "community")
    scored.append(sparse_glance_scores(sparse, members, chosen))
    both = scored[0].unionByName(scored[1]) if len(scored) > 1 else scored[0]
    return both.groupBy("node").agg(F.max("score").alias("score"))


def detect_anomalies(
    graph: Graph,
    comm_method: str = "louvain",
    anomaly_method: str = "degree",
    threshold: float = 0.6,
    attributes: Iterable[str] | None = None,
    feature_selection: str | None = None,
    percentile: float = 0.1,
    communities: DataFrame | None = None,
    community_cache_path: str | None = None,
) -> Detection:
    """Find communities, add metrics, choose features and run one detector.

    ``attributes`` names node attributes to use, metrics among them being computed first;
    without it all numeric attributes are used. Communities may be given, or are read from
    ``community_cache_path`` where a former run of the same method stored them.

    The neighbour vector as an attribute stays a map with the communities that a node's
    neighbours have; only spectral selection, which weighs all positions, makes it an array.
    """
    if anomaly_method not in ANOMALY_METHODS:
        raise ValueError(f"unknown anomaly method {anomaly_method!r}, expected one of {ANOMALY_METHODS}")
    if feature_selection is not None and feature_selection not in SELECTION_METHODS:
        raise ValueError(f"unknown feature selection {feature_selection!r}, expected one of {SELECTION_METHODS}")
    scratch = Scratch(graph.nodes.sparkSession, "detection")
    try:
        with scratch.owning():
            return _detect(
                graph, scratch, comm_method, anomaly_method, threshold, attributes, feature_selection, percentile,
                communities, community_cache_path,
            )
    except BaseException:
        scratch.drop()
        raise


def _detect(
    graph: Graph,
    scratch: Scratch,
    comm_method: str,
    anomaly_method: str,
    threshold: float,
    attributes: Iterable[str] | None,
    feature_selection: str | None,
    percentile: float,
    communities: DataFrame | None,
    community_cache_path: str | None,
) -> Detection:
    graph = Graph(scratch.save(graph.nodes, "nodes"), scratch.save(graph.edges, "edges"))
    if communities is None:
        communities = store.cached_communities(
            scratch.spark, community_cache_path, comm_method, lambda: detect_communities(graph, comm_method)
        )
    communities = scratch.save(communities, "communities")
    wanted = None if attributes is None else list(attributes)
    vector = VECTOR in missing_metrics(graph.nodes, wanted)
    width = None
    if vector:
        # As attribute the vector needs a position for every community.
        width = (communities.agg(F.max("community")).first()[0] or 0) + 1
    dense = vector and feature_selection == "spectral"
    near = None
    if anomaly_method not in ("degree", "glance") or set(missing_metrics(graph.nodes, wanted)) - {METRICS[0], METRICS[-1]}:
        near = scratch.save(neighborhoods(graph.edges, communities, vector), "neighborhoods")
    nodes = graph.nodes
    if missing_metrics(nodes, wanted):
        made = with_metrics(nodes, graph.edges, communities, wanted, width if dense else None, near)
        nodes = scratch.save(made, "attributed")
    sparse = attribute_of_maps(nodes, VECTOR, width) if vector and not dense else None
    chosen = None
    if feature_selection is not None:
        chosen = choose_features(nodes, communities, feature_selection, percentile, wanted, sparse)

    scores = None
    if anomaly_method == "degree":
        anomalies = detectors.degree_anomalies(nodes, graph.edges, threshold, near)
    elif anomaly_method == "within_communities":
        anomalies = detectors.within_community_anomalies(graph.edges, communities, threshold, keep_empty=True, near=near)
    elif anomaly_method == "CADA":
        anomalies = scores = detectors.cada_scores(graph.edges, communities, near)
    elif anomaly_method == "pseudo_CADA":
        anomalies = scores = detectors.pseudo_cada_scores(graph.edges, communities, near)
    else:
        scores = _glance(nodes, communities, wanted, chosen, sparse)
        anomalies = detectors.above(scores, threshold)
    return Detection(anomalies, scores, communities, nodes, chosen, scratch)


def refresh_communities(graph: Graph, community_cache_path: str | None, comm_method: str = "louvain") -> DataFrame:
    """Detect communities anew and replace the stored ones."""
    if not community_cache_path:
        raise ValueError("no path to store communities at")
    return store.store_communities(detect_communities(graph, comm_method), community_cache_path, comm_method)


__all__ = ["ANOMALY_METHODS", "Detection", "choose_features", "detect_anomalies", "feature_scores", "refresh_communities", "select_features"]
