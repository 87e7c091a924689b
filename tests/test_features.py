import random

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch.operators import row_blocks
from kithwatch.operators.features import (
    attribute_columns,
    feature_table,
    keep_features,
    top_features,
    with_community,
)
from kithwatch.operators.laplacian import laplacian_scores, laplacian_scores_with, rank_features
from kithwatch.operators.neighbors import nearest_affinity
from kithwatch.operators.spectral import spec_scores
from kithwatch.plans.detection import select_features


def nodes_of(spark, values):
    width = len(values[0])
    columns = ", ".join(f"f{r} double" for r in range(width))
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], f"id long, {columns}")


def random_values(count, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [[round(rng.gauss(0, spread), 2) for _ in range(width)] for _ in range(count)]


def test_attributes_are_numbers_and_vectors(spark):
    table = spark.createDataFrame(
        [("a", 1, 1.5, True, [1, 2], "x", ["t"], 3)],
        "id string, n int, x double, flag boolean, v array<int>, name string, words array<string>, community int",
    )
    assert attribute_columns(table) == ["n", "x", "flag", "v"]
    found = rows(feature_table(table), "community", "attr", "idx", "value", "whole")
    assert found == [
        (3, "flag", -1, 1.0, True),
        (3, "n", -1, 1.0, True),
        (3, "v", 0, 1.0, True),
        (3, "v", 1, 2.0, True),
        (3, "x", -1, 1.5, False),
    ]
    with pytest.raises(ValueError):
        feature_table(table, ["name"])


def test_missing_values_count_as_zero(spark):
    table = spark.createDataFrame(
        [(1, None, [1.0, 2.0]), (2, 4.0, None), (3, 5.0, [7.0])], "id long, `a b_1` double, v array<double>"
    )
    assert rows(feature_table(table), "node", "attr", "idx", "value") == [
        (1, "a b_1", -1, 0.0),
        (1, "v", 0, 1.0),
        (1, "v", 1, 2.0),
        (2, "a b_1", -1, 4.0),
        (2, "v", 0, 0.0),
        (2, "v", 1, 0.0),
        (3, "a b_1", -1, 5.0),
        (3, "v", 0, 7.0),
        (3, "v", 1, 0.0),
    ]


def test_laplacian_against_matrices(spark, sizes):
    values = [[*v, 5.0] for v in random_values(30, 3, 1)]
    label = [i % 4 if i < 25 else -1 for i in range(30)]
    nodes = nodes_of(spark, values)
    communities = spark.createDataFrame([(i, c) for i, c in enumerate(label) if c >= 0], "node long, community long")
    affinity = (np.array(label)[:, None] == np.array(label)[None]).astype(float)
    np.fill_diagonal(affinity, 0)
    expected = brute.laplacian(values, affinity)
    closed = laplacian_scores(feature_table(with_community(nodes, communities, how="left")))
    assert [s for *_, s in rows(closed)] == pytest.approx(list(expected))
    links = spark.createDataFrame(
        [(i, j, 1.0) for i in range(30) for j in range(30) if affinity[i, j]], "i long, j long, weight double"
    )
    general = laplacian_scores_with(feature_table(nodes), links)
    assert [s for *_, s in rows(general)] == pytest.approx(list(expected))


def test_laplacian_without_links(spark):
    nodes = nodes_of(spark, random_values(3, 1, 1))
    communities = spark.createDataFrame([(i, i) for i in range(3)], "node long, community long")
    (found,) = rows(laplacian_scores(feature_table(with_community(nodes, communities))), "score")
    assert np.isnan(found[0])


def test_ranking(spark):
    scores = spark.createDataFrame(
        [("a", -1, 0.5), ("b", -1, float("nan")), ("c", 1, 0.2), ("c", 0, 0.2), ("d", -1, None)],
        "attr string, idx int, score double",
    )
    best = [(attr, idx) for _, attr, idx in rows(rank_features(scores), "rank", "attr", "idx")]
    assert best[:3] == [("c", 0), ("c", 1), ("a", -1)]
    assert sorted(best[3:]) == [("b", -1), ("d", -1)]
    worst = [attr for _, attr in rows(rank_features(scores, ascending=False), "rank", "attr")]
    assert worst[:3] == ["a", "c", "c"]
    assert top_features(rank_features(scores), 0.1) == [("c", 0)]
    assert top_features(rank_features(scores), 0.5) == [("c", 0), ("c", 1)]
    assert keep_features(scores, [("c", 1)]).count() == 1


@pytest.mark.parametrize("spread", [0.5, 20.0])
def test_spec_against_pairs(spark, monkeypatch, spread):
    # Small blocks, so that pairs of different and of distant blocks occur.
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 4)
    values = random_values(60, 3, 2, spread)
    found = [s for *_, s in rows(spec_scores(nodes_of(spark, values)))]
    assert found == pytest.approx(brute.spec_by_pairs(values), rel=1e-9)
    if spread < 1:
        # Distant nodes leave many eigenvalues next to 0, and the trivial vector undefined.
        assert found == pytest.approx(brute.spec(values), rel=1e-9)


def test_spec_of_constant_features(spark):
    values = [[v[0], 3.0, 0.0] for v in random_values(10, 1, 2)]
    found = [s for *_, s in rows(spec_scores(nodes_of(spark, values)))]
    assert found[0] is not None and found[1:] == [None, None]


def test_block_pairs_by_radius(spark, monkeypatch):
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 4)
    from kithwatch.operators.scratch import Scratch

    nodes = nodes_of(spark, [[float(i)] for i in range(64)])
    vectors, _ = row_blocks.feature_vectors(nodes)
    pairs = row_blocks.block_pairs(vectors, 1, Scratch(spark, "test"), radius=5.0).select("left", "right")
    met = [(a, b) for left, right in pairs.collect() for a in left for b in right]
    near = {(a, b) for a in range(64) for b in range(64) if 0 <= b - a <= 5}
    assert {tuple(sorted(p)) for p in met} >= near
    blocks = 64 // 4
    assert pairs.count() < blocks * (blocks + 1) // 2


def test_block_pairs_by_the_bounds_of_two_features(spark, monkeypatch):
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 4)
    from kithwatch.operators.scratch import Scratch

    # All agree in the widest feature but for a few, so that only the other tells blocks apart.
    values = [[float(i % 2), i / 64] for i in range(64)] + [[40.0, 0.0], [-40.0, 1.0]]
    vectors, _ = row_blocks.feature_vectors(nodes_of(spark, [[a, 30 * b] for a, b in values]))
    pairs = row_blocks.block_pairs(vectors, 2, Scratch(spark, "test"), radius=3.0)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = pairs.select("left_nodes", "right_nodes").collect()
    met = {tuple(sorted((a, b))) for left, right in made for a in left for b in right}
    point = [(a, 30 * b) for a, b in values]
    near = {(a, b) for a in range(66) for b in range(a, 66) if np.hypot(*np.subtract(point[a], point[b])) <= 3}
    assert met >= near
    blocks = pairs.where("same").count()
    assert len(made) < blocks * (blocks + 1) // 3


@pytest.mark.parametrize("scale, width", [(1.0, 40), (0.01, 5), (30.0, 2), (1e8, 2)])
def test_spec_sums_by_products(scale, width):
    """Also with exact and near copies beside rows that are far apart."""
    from kithwatch.operators import spectral

    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(300, width)) * scale + 5, rng.normal(size=(290, width)) * scale + 5
    right[:2] = left[:2]
    right[2] = left[2] * (1 + 1e-9)
    for one, other in ((left, right), (left, left)):
        square = np.square(one[:, None, :] - other[None, :, :])
        weight, cut = spectral._weights_and_cut(one, other, 0.5)
        wanted = np.exp(-0.5 * square.sum(axis=2))
        assert weight == pytest.approx(wanted, rel=1e-9)
        assert cut == pytest.approx((wanted[:, :, None] * square).sum(axis=(0, 1)), rel=1e-9)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest(spark, sizes, monkeypatch, kind):
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 4)
    values = np.array(random_values(30, 4, 6))
    nodes = nodes_of(spark, values.tolist()).withColumn("id", F.col("id").cast(kind))
    unit = values / np.linalg.norm(values, axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 12)
    expected = {(i, i) for i in range(30)}
    for i in range(30):
        for j in sorted((j for j in range(30) if j != i), key=lambda j: (-cosine[i, j], j))[:3]:
            expected |= {(i, j), (j, i)}
    found = rows(nearest_affinity(nodes, k=3))
    assert {(int(i), int(j)) for i, j, _ in found} == expected
    assert len(found) == len(expected)


def test_selection(spark):
    nodes = nodes_of(spark, [[i % 2, i] for i in range(8)])
    communities = spark.createDataFrame([(i, i % 2) for i in range(8)], "node long, community long")
    assert select_features(nodes, communities, "laplacian") == [("f0", -1)]
    assert len(select_features(nodes, communities, "spectral", percentile=1.0)) == 2
    with pytest.raises(ValueError):
        select_features(nodes, communities, "variance")
