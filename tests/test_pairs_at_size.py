"""Work on all pairs of nodes that must not grow with the pairs where it need not."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from kithwatch.operators import neighbors, row_blocks, spectral
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.spectral import spec_scores


def nodes_of(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(values)], "id long, v array<double>")


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("apart", [0.0, 0.4, 6.0, 35.0])
def test_moments_of_blocks_are_the_sums_over_their_pairs(width, apart):
    """To nine digits, also where all weights are next to 0, rows are copies, or a feature does not vary."""
    rng = np.random.default_rng(5)
    left, right = (rng.random((500, width)) * 1.5 / width + 3 for _ in range(2))
    right[:, 0] += apart
    if apart < 1:
        right[:40] = left[:40]
    if width > 1:
        left[:, -1] = right[:, -1] = 2.0
    found = spectral._sums_by_moments(left, right if apart else left, 0.5)
    weight, cut = spectral._by_differences(left, right if apart else left, 0.5)
    other = right if apart else left
    a, b = weight.sum(axis=1), weight.sum(axis=0)
    wanted = (cut, a @ np.square(left), b @ np.square(other), a @ left, b @ other, a.sum())
    for one, two in zip(found, wanted, strict=True):
        assert one == pytest.approx(two, rel=1e-9, abs=0)


def test_no_moments_where_they_would_lose_digits_or_time():
    rng = np.random.default_rng(6)
    assert spectral._sums_by_moments(rng.random((400, 2)) * 9, rng.random((400, 2)), 1.0) is None
    assert spectral._sums_by_moments(rng.random((3, 2)), rng.random((3, 2)), 1.0) is None
    assert spectral._sums_by_moments(rng.random((400, 9)) / 9, rng.random((400, 9)) / 9, 1.0) is None
    assert spectral._sums_by_moments(np.array([[np.nan, 0.0]] * 400), rng.random((400, 2)), 1.0) is None
    # Copies weigh all there is, and what differs weighs next to nothing.
    far = np.where(np.arange(400) < 40, 0.0, 7.0)[:, None]
    assert spectral._sums_by_moments(np.zeros((400, 1)), far, 1.0) is None


def test_blocks_within_a_radius_are_about_as_long_as_wide(spark, monkeypatch):
    """Also beside a few rows far out; before, slabs were as many as shuffle partitions."""
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 16)
    monkeypatch.setattr(row_blocks, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    values = rng.random((2048, 2)) * [160.0, 10.0]
    values[:2] = [[5000.0, 5.0], [3.0, -5000.0]]
    vectors, _ = row_blocks.feature_vectors(nodes_of(spark, values))
    made = row_blocks.block_pairs(vectors, 2, Scratch(spark, "square"), radius=1.0).where("same").select("left").collect()
    extents = np.array([np.ptp(np.reshape(row.left, (-1, 2)), axis=0) for row in made])
    assert 128 <= len(made) <= 3 * 128
    assert np.median(extents[:, 0]) < 8 and np.median(extents[:, 1]) < 8


def test_spec_of_dense_nodes(spark):
    """So near each other that blocks go by moments, and a few far out that do not."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.random((1500, 2)) * [1.5, 1.0], rng.random((20, 2)) * 40])
    found = [score for *_, score in rows(spec_scores(nodes_of(spark, values)))]
    assert found == pytest.approx(brute.spec_by_pairs(values.tolist()), rel=1e-9)


def _nearest_by_pairs(x, y, k, same):
    near = np.round(neighbors._unit(x) @ neighbors._unit(y).T, neighbors.DIGITS)
    near[np.isnan(near)] = -np.inf
    if same:
        np.fill_diagonal(near, -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in order[i] if near[i, j] > -np.inf}


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("kind", ["apart", "ties", "equal", "few"])
def test_nearest_of_large_blocks_piece_by_piece(monkeypatch, kind, same):
    """Nodes in any order; rows that are not finite are like no other."""
    monkeypatch.setattr(neighbors, "PIECE_ROWS", 64)
    rng = np.random.default_rng(9)
    x = {
        "apart": rng.normal(size=(300, 8)),
        "ties": np.repeat(rng.normal(size=(6, 3)), 50, axis=0) * rng.integers(1, 9, (300, 1)),
        "equal": np.ones((300, 2)),
        "few": rng.normal(size=(4, 3)),
    }[kind]
    y = x[: len(x) // 2] * 3.0
    if kind == "apart":
        x[3, 0], x[4], x[5] = np.nan, np.inf, 0.0
    a, b = rng.permutation(len(x)), rng.permutation(len(y))
    right, right_nodes = (x[a], a) if same else (y[b], b + 1000)
    columns = [[same], [x[a].ravel().tolist()], [right.ravel().tolist()], [a.tolist()], [right_nodes.tolist()]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["same", "left", "right", "left_nodes", "right_nodes"])
    made = [tuple(row.values())[:2] for part in neighbors._closest(5, x.shape[1], pa.int64())(iter([batch])) for row in part.to_pylist()]
    wanted = _nearest_by_pairs(x, x, 5, True) if same else set()
    if not same:
        wanted = {(i, j + 1000) for i, j in _nearest_by_pairs(x, y, 5, False)}
        wanted |= {(i + 1000, j) for i, j in _nearest_by_pairs(y, x, 5, False)}
    assert set(made) == wanted and len(made) == len(wanted)


def test_blocks_of_all_pairs_grow_with_the_nodes(spark, monkeypatch):
    """Before, a block had at most 2,048 rows, so it travelled and handed on its best once for each of them."""
    monkeypatch.setattr(row_blocks, "BLOCK_ROWS", 4)
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", 4)
    vectors, _ = row_blocks.feature_vectors(nodes_of(spark, np.random.default_rng(4).normal(size=(640, 2))))
    pairs = row_blocks.block_pairs(vectors, 2, Scratch(spark, "whole"))
    assert pairs.where("same").count() <= 2 * spark.sparkContext.defaultParallelism + int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(row_blocks, "WHOLE_BYTES", 16 * 10)
    sizes = row_blocks.block_pairs(vectors, 2, Scratch(spark, "whole")).where("same").select("left_nodes").collect()
    assert max(len(row.left_nodes) for row in sizes) <= 10


def test_features_travel_without_their_names(spark):
    """A node lacks a feature, a value is null; before, each link carried and searched a map of names."""
    from kithwatch.operators.laplacian import laplacian_scores_with

    values = {0: {"a": 1.0, "b": 4.0}, 1: {"a": 2.0, "b": None}, 2: {"a": 4.0}}
    features = spark.createDataFrame([(n, f, -1, v) for n, of in values.items() for f, v in of.items()], "node long, attr string, idx int, value double")
    links = [(0, 1, 1.0), (1, 0, 1.0), (0, 2, 2.0), (2, 0, 2.0), (1, 1, 3.0)]
    scores = laplacian_scores_with(features, spark.createDataFrame(links, "i long, j long, weight double"))
    assert "explode(fi" not in scores._jdf.queryExecution().optimizedPlan().toString()
    strength = {0: 3.0, 1: 4.0, 2: 2.0}
    center = sum(strength[n] * values[n]["a"] for n in values) / 9
    f = {n: values[n]["a"] - center for n in values}
    within = sum(w * f[i] * f[j] for i, j, w in links)
    spread = sum(strength[n] * f[n] ** 2 for n in f)
    found = {row.attr: row.score for row in scores.collect()}
    assert found["a"] == pytest.approx(1 - within / spread) and np.isnan(found["b"])
