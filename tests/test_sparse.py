"""Attributes with very many positions, one pass of metrics, and what a run leaves behind."""

import random
import shutil
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch import Graph, detect_anomalies
from kithwatch.operators import detectors
from kithwatch.operators.features import feature_table, with_community
from kithwatch.operators.laplacian import laplacian_scores, rank_features
from kithwatch.operators.metrics import METRICS, VECTOR, neighborhoods, with_metrics
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.sparse_features import (
    attribute_of_maps,
    ranked_features,
    sparse_glance_scores,
    sparse_laplacian_scores,
)
from kithwatch.sources.graphml import read_graphml


def random_graph(spark, count, links, labels, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(count), 2))) for _ in range(links)}
    # A hub sees most communities, the last nodes nobody.
    edges |= {(0, i) for i in range(1, count - 5, 2)}
    label = {i: rng.choice(labels) for i in range(count)}
    nodes = spark.createDataFrame([(i,) for i in range(count)], "id long")
    table = spark.createDataFrame(sorted(edges), "src long, dst long")
    return nodes, table, spark.createDataFrame(list(label.items()), "node long, community long")


@pytest.fixture(params=[(40, 60, [0, 1, 2, 5], 1), (60, 40, list(range(12)), 2)], scope="module")
def vectors(spark, request):
    """Nodes with the neighbour vector as a map and as an array, and their communities."""
    nodes, edges, communities = random_graph(spark, *request.param)
    width = max(request.param[2]) + 1
    sparse = with_metrics(nodes, edges, communities, [VECTOR]).cache()
    dense = with_metrics(nodes, edges, communities, [VECTOR], width).cache()
    return sparse, dense, communities, width


def test_glance_of_maps_equals_arrays(vectors):
    sparse, dense, communities, width = vectors
    wanted = dict(rows(detectors.glance(dense, communities)))
    found = dict(rows(sparse_glance_scores(attribute_of_maps(sparse, VECTOR, width), communities)))
    assert found == pytest.approx(wanted, abs=1e-12) and any(wanted.values())


def test_glance_of_some_positions(spark, vectors):
    sparse, dense, communities, width = vectors
    some = [(VECTOR, i) for i in range(0, width, 2)]
    wanted = dict(rows(detectors.glance(dense, communities, selected=some)))
    chosen = spark.createDataFrame(some, "attr string, idx long")
    assert dict(rows(sparse_glance_scores(attribute_of_maps(sparse, VECTOR, width), communities, chosen))) == pytest.approx(wanted)


def test_glance_of_maps_with_hot_keys_split(spark):
    nodes, edges, communities = random_graph(spark, 25, 20, [0, 1, 3], 3)
    wanted = dict(rows(detectors.glance(with_metrics(nodes, edges, communities, [VECTOR], 4), communities)))
    spark.conf.set("spark.kithwatch.hotRows", "3")
    spark.conf.set("spark.kithwatch.windowRows", "3")
    try:
        found = dict(rows(sparse_glance_scores(attribute_of_maps(with_metrics(nodes, edges, communities, [VECTOR]), VECTOR, 4), communities)))
    finally:
        spark.conf.unset("spark.kithwatch.hotRows")
        spark.conf.unset("spark.kithwatch.windowRows")
    assert found == pytest.approx(wanted, abs=1e-12)


def test_laplacian_of_maps_equals_arrays(vectors):
    sparse, dense, communities, width = vectors
    wanted = laplacian_scores(feature_table(with_community(dense, communities)))
    found = sparse_laplacian_scores(attribute_of_maps(sparse, VECTOR, width), communities)
    assert {i: s for _, i, s in rows(found)} == pytest.approx({i: s for _, i, s in rows(wanted)}, abs=1e-9)
    assert rows(ranked_features(wanted), "attr", "idx", "rank") == rows(rank_features(wanted), "attr", "idx", "rank")


def test_runs_with_the_vector_equal_runs_with_an_array(spark):
    nodes, edges, communities = random_graph(spark, 50, 70, list(range(8)), 4)
    nodes = nodes.withColumn("x", F.col("id") % 7)
    dense = with_metrics(nodes, edges, communities, [VECTOR], 8)
    options = {"anomaly_method": "glance", "attributes": ["x", VECTOR], "communities": communities, "feature_selection": "laplacian", "percentile": 0.5}
    found = detect_anomalies(Graph(nodes, edges), **options)
    wanted = detect_anomalies(Graph(dense, edges), **options)
    assert dict(rows(found.scores)) == pytest.approx(dict(rows(wanted.scores)))
    assert found.selected == wanted.selected and len(found.selected) == 4


def test_very_many_communities(spark):
    """A dense vector would have 200 times 100,000 cells."""
    count, width = 200, 100_000
    nodes = spark.range(count)
    edges = spark.createDataFrame([(i, (i * 7 + 1) % count) for i in range(count) if i < (i * 7 + 1) % count], "src long, dst long")
    communities = spark.createDataFrame([(i, (i % 20) * 5263) for i in range(count - 1)] + [(count - 1, width - 1)], "node long, community long")
    found = detect_anomalies(
        Graph(nodes, edges), anomaly_method="glance", attributes=[VECTOR], communities=communities,
        feature_selection="laplacian", percentile=0.01, threshold=0.5,
    )
    assert len(found.selected) == width // 100
    assert found.scores.count() == count and dict(found.nodes.dtypes)[VECTOR] == "map<bigint,bigint>"
    found.release()


def test_one_join_of_the_edges(spark):
    nodes, edges, communities = random_graph(spark, 30, 40, [0, 1, 2], 5)
    plan = with_metrics(nodes, edges, communities, METRICS)._jdf.queryExecution().optimizedPlan().toString()
    # The neighbours' communities, and the nodes with what was found.
    assert plan.count("Join ") == 2
    assert neighborhoods(edges, communities)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_clashing_names(spark):
    nodes = spark.createDataFrame([(1, 5, 6, 7), (2, 5, 6, 7)], "id long, node long, total long, member long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    communities = spark.createDataFrame([(1, 0), (2, 1)], "node long, community long")
    found = with_metrics(nodes, edges, communities, METRICS)
    assert [tuple(row) for row in found.orderBy("id").collect()] == [(1, 5, 6, 7, 1, 0, 1, {1: 1}, 0), (2, 5, 6, 7, 1, 0, 1, {0: 1}, 1)]


GRAPHML = """<graphml><key id="d" for="node" attr.name="x" attr.type="double"/><graph edgedefault="undirected">
{nodes}{edges}</graph></graphml>"""


@pytest.mark.parametrize("method", ["pseudo_CADA", "glance"])
def test_a_run_reads_its_input_once_and_leaves_nothing(spark, tmp_path, method):
    names = "".join(f'<node id="n{i}"><data key="d">{i % 4}</data></node>' for i in range(12))
    links = "".join(f'<edge source="n{i}" target="n{(i + j) % 12}"/>' for i in range(11) for j in (1, 4))
    (tmp_path / "graph").mkdir()
    (tmp_path / "graph" / "g.graphml").write_text(GRAPHML.format(nodes=names, edges=links))
    graph = read_graphml(spark, str(tmp_path / "graph"))
    with detect_anomalies(graph, anomaly_method=method, attributes=["x", *METRICS], threshold=0.01) as found:
        # Whatever is left to do does without the files.
        shutil.rmtree(tmp_path / "graph")
        kept = Path(found.scratch.base)
        assert kept.exists()
        found.save(str(tmp_path / "out"))
    assert not kept.exists()
    assert spark.read.parquet(str(tmp_path / "out" / "anomalies")).count() > 0


def test_a_failed_run_leaves_nothing(spark):
    nodes, edges, communities = random_graph(spark, 10, 10, [0], 6)
    root = Path(Scratch(spark, "look").base).parent
    before = set(root.iterdir()) if root.exists() else set()
    with pytest.raises(ValueError):
        detect_anomalies(Graph(nodes, edges), comm_method="none", anomaly_method="CADA")
    assert (set(root.iterdir()) if root.exists() else set()) == before
