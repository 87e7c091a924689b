import math
import random

import brute
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch import Graph, detect_anomalies
from kithwatch.operators import detectors
from kithwatch.operators.features import feature_table, with_community
from kithwatch.operators.glance import mean_differences
from kithwatch.operators.metrics import METRICS, community_vectors, missing_metrics, with_metrics
from kithwatch.plans.detection import refresh_communities

NODES = list("abcdefg")
# g is alone, f has no community, a has a self-loop.
EDGES = [("a", "a"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]
LABELS = {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "g": 1}


@pytest.fixture
def graph(spark):
    return Graph(
        spark.createDataFrame([(n,) for n in NODES], "id string"),
        spark.createDataFrame(EDGES, "src string, dst string"),
    )


@pytest.fixture
def communities(spark):
    return spark.createDataFrame(list(LABELS.items()), "node string, community long")


def test_metrics(graph, communities, sizes):
    found = with_metrics(graph.nodes, graph.edges, communities, METRICS)
    assert rows(found) == [
        ("a", 4, 3, 0, {0: 3}, 0),
        ("b", 2, 2, 0, {0: 2}, 0),
        ("c", 3, 2, 1, {0: 2, 1: 1}, 0),
        ("d", 2, 1, 1, {0: 1, 1: 1}, 1),
        ("e", 2, 1, 0, {1: 1}, 1),
        ("f", 1, 0, 1, {1: 1}, None),
        ("g", 0, 0, 0, {}, 1),
    ]


def test_metrics_on_request(graph, communities):
    assert with_metrics(graph.nodes, graph.edges, communities, None).columns == ["id"]
    outer = with_metrics(graph.nodes, graph.edges, communities, ["outerCommunityEdgesAmount", "unknown"])
    assert outer.columns == ["id", "outerCommunityEdgesAmount"]
    known = graph.nodes.withColumn("degree", F.lit(-1))
    assert missing_metrics(known, ["degree", "community"]) == ["community"]
    assert rows(with_metrics(known, graph.edges, communities, ["degree"]), "degree") == [(-1,)] * 7


def test_dense_vectors(graph, communities):
    dense = dict(rows(community_vectors(graph.edges, communities, width=3)))
    assert dense["c"] == [2, 1, 0]
    nodes = with_metrics(graph.nodes, graph.edges, communities, ["neighborsCommunityVector"], 3)
    assert dict(rows(nodes))["g"] == [0, 0, 0]


def test_degree(graph, sizes):
    degree = {"a": 4, "b": 2, "c": 3, "d": 2, "e": 2, "f": 1, "g": 0}
    mean = sum(degree.values()) / 7
    deviation = math.sqrt(sum((d - mean) ** 2 for d in degree.values()) / 7)
    for threshold in (0.6, 1.5):
        expected = sorted((n, d) for n, d in degree.items() if abs(d - mean) > threshold * deviation)
        assert rows(detectors.degree_anomalies(graph.nodes, graph.edges, threshold)) == expected
    # With equal degrees nothing deviates.
    pair = graph.edges.where("src = 'a' and dst = 'b'")
    assert detectors.degree_anomalies(graph.nodes.where("id in ('a', 'b')"), pair, 0.0).isEmpty()


def test_exactly_at_the_limit_is_no_anomaly(spark):
    # Inner links 4, 1, 1, 1, 1 deviate by 2.4, 0.6, ... at a deviation of 1.2.
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    one = spark.createDataFrame([(i, 0) for i in range(5)], "node long, community long")
    assert detectors.within_community_anomalies(star, one, 2.0).isEmpty()
    assert rows(detectors.within_community_anomalies(star, one, 1.99)) == [(0, 0)]


def test_within_communities(graph, communities, sizes):
    assert rows(detectors.within_community_anomalies(graph.edges, communities, 1.3)) == [(0, "a"), (1, "g")]
    kept = detectors.within_community_anomalies(graph.edges, communities, 1.412, keep_empty=True)
    assert sorted(map(str, kept.collect())) == [
        "Row(community=0, node='a')",
        "Row(community=1, node='g')",
    ]
    none = detectors.within_community_anomalies(graph.edges, communities, 5.0, keep_empty=True)
    assert rows(none.select("community", F.coalesce("node", F.lit("-")))) == [(0, "-"), (1, "-")]


def test_cada(graph, communities, sizes):
    assert rows(detectors.cada_scores(graph.edges, communities)) == [
        ("a", 1.0),
        ("b", 1.0),
        ("c", 1.5),
        ("d", 2.0),
        ("e", 1.0),
        ("g", 0.0),
    ]
    assert rows(detectors.pseudo_cada_scores(graph.edges, communities)) == [
        ("a", 0.0),
        ("b", 0.0),
        ("c", 0.5),
        ("d", 1.0),
        ("e", 0.0),
        ("g", math.inf),
    ]


def groups(spark, seed, count, whole):
    rng = random.Random(seed)
    label = {i: rng.choice([0, 0, 0, 1, 2]) for i in range(count)}
    draw = (lambda: rng.randint(-4, 4)) if whole else (lambda: round(rng.gauss(0, 2), 3))
    values = {i: [draw(), draw()] for i in range(count)}
    nodes = spark.createDataFrame(
        [(i, *values[i]) for i in range(count)], f"id long, x {'int' if whole else 'double'}, y {'int' if whole else 'double'}"
    )
    communities = spark.createDataFrame(list(label.items()), "node long, community long")
    members = {c: {i: values[i] for i in values if label[i] == c} for c in set(label.values())}
    return nodes, communities, members


@pytest.mark.parametrize("whole", [True, False])
def test_glance_against_pairs(spark, sizes, whole):
    nodes, communities, members = groups(spark, 3, 40, whole)
    expected = brute.glance(members)
    found = dict(rows(detectors.glance(nodes, communities)))
    assert found == pytest.approx(expected, abs=1e-12)


def test_equal_to_the_mean_is_not_far(spark, sizes):
    # The mean difference of 0, 0, 4, 4 is 2; of 0, 2, 2, 4 it is 1.5; of 0, 1, 3 it is 4/3.
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate([0, 2, 0, 4, 0, 0, 4, 4])], "id long, x int")
    communities = spark.createDataFrame([(i, i // 4) for i in range(8)], "node long, community long")
    found = dict(rows(detectors.glance(nodes, communities)))
    x = [0, 2, 0, 4]
    mean = sum(abs(a - b) for a in x for b in x) / 16
    assert [found[i] for i in range(4)] == [sum(abs(a - b) > mean for b in x) / 4 for a in x]
    assert [found[i] for i in range(4, 8)] == [0.5] * 4


def test_mean_differences(spark, sizes):
    nodes, communities, members = groups(spark, 4, 30, True)
    found = mean_differences(feature_table(with_community(nodes, communities)))
    for community, attr, _, n, mean in found.collect():
        v = [x["xy".index(attr)] for x in members[community].values()]
        assert n == len(v)
        assert mean == pytest.approx(sum(abs(a - b) for a in v for b in v) / n**2)


def test_large_whole_numbers_are_exact(spark):
    big = 2**52
    nodes = spark.createDataFrame([(0, big), (1, big + 2), (2, big), (3, big + 2)], "id long, x long")
    communities = spark.createDataFrame([(i, 0) for i in range(4)], "node long, community long")
    # The mean difference is 1, all others are 0 or 2 away.
    assert rows(detectors.glance(nodes, communities), "score") == [(0.5,)] * 4


@pytest.mark.parametrize("base", [2**53, 2**62, -(2**63), 2**63 - 8])
def test_whole_numbers_that_doubles_cannot_tell_apart(spark, base, sizes):
    values = [base, base + 1, base + 1, base + 2, base + 4, base + 7]
    nodes = spark.createDataFrame(list(enumerate(values)), "id long, x long")
    communities = spark.createDataFrame([(i, 0) for i in range(6)], "node long, community long")
    total = sum(abs(a - b) for a in values for b in values)
    wanted = [(i, sum(abs(a - b) * 36 > total for b in values) / 6) for i, a in enumerate(values)]
    assert rows(detectors.glance(nodes, communities)) == wanted and len({score for _, score in wanted}) > 1


def test_whole_numbers_at_both_ends(spark):
    values = [-(2**63), 2**63 - 1, 0, 5]
    nodes = spark.createDataFrame(list(enumerate(values)), "id long, x long")
    communities = spark.createDataFrame([(i, 0) for i in range(4)], "node long, community long")
    total = sum(abs(a - b) for a in values for b in values)
    wanted = [(i, sum(abs(a - b) * 16 > total for b in values) / 4) for i, a in enumerate(values)]
    assert rows(detectors.glance(nodes, communities)) == wanted


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_values_that_are_not_finite_score_nothing(spark, bad, sizes):
    nodes = spark.createDataFrame([(0, bad, 0), (1, 1.0, 9), (2, 2.0, 0)], "id long, x double, y int")
    communities = spark.createDataFrame([(i, 0) for i in range(3)], "node long, community long")
    assert rows(detectors.glance(nodes.select("id", "x"), communities), "score") == [(0.0,)] * 3
    assert max(rows(detectors.glance(nodes, communities), "score")) == (2 / 3,)


def test_glance_without_attributes(graph, communities):
    assert rows(detectors.glance(graph.nodes, communities), "score") == [(0.0,)] * 6


def test_runs(spark, graph, communities, tmp_path):
    nodes = graph.nodes.withColumn("x", F.ascii("id"))
    full = Graph(nodes, graph.edges)
    cache = str(tmp_path / "cache")

    def run(method, **more):
        return detect_anomalies(full, anomaly_method=method, communities=communities, **more)

    assert rows(run("degree").anomalies) == rows(detectors.degree_anomalies(nodes, graph.edges, 0.6))
    assert run("within_communities").anomalies.columns == ["community", "node"]
    assert run("CADA").anomalies.count() == run("pseudo_CADA").anomalies.count() == 6
    scored = run("glance", threshold=0.5)
    assert rows(scored.anomalies) == rows(scored.scores.where("score > 0.5"))
    picked = run("glance", attributes=["degree", "neighborsCommunityVector"], feature_selection="laplacian")
    assert len(picked.selected) == 1
    assert picked.nodes.columns == ["id", "x", "degree", "neighborsCommunityVector"]
    scored.save(str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results" / "anomalies")).count() == scored.anomalies.count()
    run("pseudo_CADA").save_json(str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).where("value like '%Infinity%'").count() == 1
    with pytest.raises(ValueError):
        run("glance", threshold=2.0).save_json(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        run("isolation")
    with pytest.raises(ValueError):
        run("glance", feature_selection="variance")

    first = detect_anomalies(full, anomaly_method="CADA", community_cache_path=cache)
    stored = rows(first.communities)
    again = detect_anomalies(full, anomaly_method="CADA", community_cache_path=cache)
    assert rows(again.communities) == stored == rows(spark.read.parquet(f"{cache}/louvain"))
    assert rows(refresh_communities(full, cache)) == stored
    with pytest.raises(ValueError):
        refresh_communities(full, None)
