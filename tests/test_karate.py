"""Known figures of a small public graph: the friendships of Zachary's karate club (1977)."""

import pytest
from conftest import rows

from kithwatch.graph import Graph
from kithwatch.operators import detectors
from kithwatch.operators.components import connected_components
from kithwatch.operators.girvan_newman import edge_betweenness
from kithwatch.operators.louvain import louvain_communities
from kithwatch.operators.metrics import degrees
from kithwatch.operators.modularity import modularity

# The 78 friendships, each with the smaller member first.
FRIENDS = {
    1: [2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32],
    2: [3, 4, 8, 14, 18, 20, 22, 31],
    3: [4, 8, 9, 10, 14, 28, 29, 33],
    4: [8, 13, 14],
    5: [7, 11],
    6: [7, 11, 17],
    7: [17],
    9: [31, 33, 34],
    10: [34],
    14: [34],
    15: [33, 34],
    16: [33, 34],
    19: [33, 34],
    20: [34],
    21: [33, 34],
    23: [33, 34],
    24: [26, 28, 30, 33, 34],
    25: [26, 28, 32],
    26: [32],
    27: [30, 34],
    28: [34],
    29: [32, 34],
    30: [33, 34],
    31: [33, 34],
    32: [33, 34],
    33: [34],
}
# The published parts of two and of any number of groups with the highest modularity.
INSTRUCTOR = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 17, 18, 20, 22]
BEST = [[1, 2, 3, 4, 8, 12, 13, 14, 18, 20, 22], [5, 6, 7, 11, 17], [9, 10, 15, 16, 19, 21, 23, 27, 30, 31, 33, 34], [24, 25, 26, 28, 29, 32]]


@pytest.fixture(scope="module")
def club(spark):
    edges = [(a, b) for a, others in FRIENDS.items() for b in others]
    assert len(edges) == 78
    return Graph(spark.range(1, 35), spark.createDataFrame(edges, "src long, dst long"))


def labels(spark, groups):
    return spark.createDataFrame([(node, i) for i, group in enumerate(groups) for node in group], "node long, community long")


def test_degrees(club):
    found = dict(rows(degrees(club.nodes, club.edges)))
    assert (found[34], found[1], found[33], found[12]) == (17, 16, 12, 1)
    # Mean 4.59, population deviation 3.82.
    assert [n for n, _ in rows(detectors.degree_anomalies(club.nodes, club.edges, 2.5))] == [1, 34]


def test_modularity(spark, club):
    assert modularity(club.edges, labels(spark, BEST)).first()[0] == pytest.approx(0.4198, abs=5e-5)
    halves = [INSTRUCTOR, sorted(set(range(1, 35)) - set(INSTRUCTOR))]
    assert modularity(club.edges, labels(spark, halves)).first()[0] == pytest.approx(0.3715, abs=5e-5)


def test_louvain(club):
    found = louvain_communities(club.nodes, club.edges)
    assert modularity(club.edges, found).first()[0] > 0.38


def test_betweenness(club):
    found = {(a, b): value for a, b, value in rows(edge_betweenness(club.nodes, club.edges))}
    assert max(found, key=found.get) == (1, 32)
    assert found[1, 32] == pytest.approx(71.3929, abs=5e-5)
    assert found[1, 12] == 33.0 and found[1, 6] == pytest.approx(43.8333, abs=5e-5)


def test_one_component(club):
    assert {c for _, c in rows(connected_components(club.nodes, club.edges))} == {1}
