"""Figures of the product co-purchase graph, worked out by comparing every pair."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch import Graph, detect_anomalies
from kithwatch.operators import detectors
from kithwatch.operators.features import feature_table, with_community
from kithwatch.operators.girvan_newman import edge_betweenness, girvan_newman_communities
from kithwatch.operators.laplacian import laplacian_scores, rank_features
from kithwatch.operators.louvain import louvain_communities
from kithwatch.operators.modularity import modularity
from kithwatch.sources.graphml import read_graphml

GIVEN = "modularity_class"


@pytest.fixture(scope="module")
def full(spark, golden_folder):
    (path,) = [p for p in Path(golden_folder).rglob("*.graphml") if GIVEN in p.read_text()]
    graph = read_graphml(spark, str(path), name_by="id")
    return Graph(graph.nodes.cache(), graph.edges.cache())


@pytest.fixture(scope="module")
def graph(full):
    return Graph(full.nodes.drop("label", GIVEN, "componentnumber"), full.edges)


@pytest.fixture(scope="module")
def communities(full):
    return full.nodes.select(F.col("id").alias("node"), F.col(GIVEN).alias("community")).cache()


def test_size(graph):
    assert (graph.nodes.count(), graph.edges.count(), len(graph.nodes.columns)) == (124, 335, 31)


def test_degree(graph):
    assert detectors.degree_anomalies(graph.nodes, graph.edges, 2.0).count() == 7
    assert detectors.degree_anomalies(graph.nodes, graph.edges, 0.6).count() == 67


def test_within_communities(graph, communities):
    for threshold, expected in ((2.0, [0, 0, 2, 1, 1, 0, 2, 0]), (0.6, [6, 10, 19, 8, 7, 8, 12, 7])):
        found = detectors.within_community_anomalies(graph.edges, communities, threshold, keep_empty=True)
        assert [n for _, n in rows(found.groupBy("community").agg(F.count("node")))] == expected


def test_cada(graph, communities):
    total, largest = detectors.cada_scores(graph.edges, communities).agg(F.sum("score"), F.max("score")).first()
    assert (total, largest) == (pytest.approx(144.44246031746033), 2.0)
    scores = detectors.pseudo_cada_scores(graph.edges, communities)
    assert scores.agg(F.sum("score")).first()[0] == pytest.approx(21.509126984126983)
    assert scores.where("score > 0").count() == 49


def test_modularity(graph, communities):
    assert modularity(graph.edges, communities).first()[0] == pytest.approx(0.677709957674315)


def test_laplacian(graph, communities):
    features = feature_table(with_community(graph.nodes, communities))
    best = rank_features(laplacian_scores(features)).orderBy("rank").limit(3).collect()
    assert [(r.attr, round(r.score, 6)) for r in best] == [
        ("Number_of_reviews", 0.656888),
        ("Min_Votes", 0.699625),
        ("Number_of_different_authors", 0.69999),
    ]


def test_glance(graph, communities):
    found = detect_anomalies(graph, anomaly_method="glance", communities=communities)
    assert found.anomalies.agg(F.count("*"), F.max("score")).first() == (118, pytest.approx(0.9666666666666667))
    chosen = detect_anomalies(graph, anomaly_method="glance", feature_selection="laplacian", communities=communities)
    assert chosen.anomalies.agg(F.count("*"), F.max("score")).first() == (31, pytest.approx(0.95))


def test_betweenness(graph):
    found = edge_betweenness(graph.nodes, graph.edges).cache()
    best = found.orderBy(F.desc("betweenness")).first()
    assert tuple(best) == ("B00004R99J", "B00005KARI", pytest.approx(1635.0))
    assert found.agg(F.sum("betweenness")).first()[0] == pytest.approx(33492.0)


def test_girvan_newman(graph):
    found = girvan_newman_communities(graph.nodes, graph.edges)
    assert sorted(n for _, n in rows(found.groupBy("community").count())) == [15, 109]


def test_louvain(graph):
    found = louvain_communities(graph.nodes, graph.edges).cache()
    assert found.count() == 124
    assert modularity(graph.edges, found).first()[0] >= 0.67
