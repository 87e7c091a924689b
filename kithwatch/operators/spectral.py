"""SPEC feature scores (Zhao, Liu 2007) from all pairs of nodes.

The score compares how a feature varies between similar nodes with how it varies overall.
With similarity ``w = exp(-gamma * distance^2)`` and the trivial eigenvector left out it is

    1/2 sum w_ij (f_i - f_j)^2  /  (sum d_i f_i^2 - (sum d_i f_i)^2 / sum d_i),

``d`` being the row sums of ``w``, so no eigenvector is ever computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.laplacian import FEATURE
from kithwatch.operators.row_blocks import block_pairs, feature_vectors, matrices
from kithwatch.operators.scratch import Scratch

# Fixed value: exp of less than minus this is exactly 0 in double precision.
UNDERFLOW = 746.0
# Below this part of its own square sum a feature counts as constant.
CONSTANT = 1e-12

_SUMS = "cut array<double>, square array<double>, linear array<double>, mass double"


# Products of rows may stand for differences where they move an exponent by less than this.
EXPONENT_ERROR = 1e-11
# Pairs closer than this part of the largest square are summed difference by difference.
CLOSE = 1e-4
# Blocks of at most so many features are summed by moments, if no row lies further from the centre of its
# block than lets the mixed part of an exponent reach this.
MOMENT_FEATURES = 3
MOMENT_REACH = 6.0
# Rows of the left block that are paired at a time, so that matrices of pairs stay near the processor.
PIECE_ROWS = 128
# Sums by moments whose rounding may reach this part of them are taken pair by pair.
MOMENT_ERROR = 1e-10
# Terms of a moment that cost as much as the difference of one pair.
TERMS_A_PAIR = 16


def _by_differences(left: np.ndarray, right: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    width = left.shape[1]
    distance = np.zeros((len(left), len(right)))
    for r in range(width):
        distance += np.square(left[:, r, None] - right[None, :, r])
    weight = np.exp(-gamma * distance)
    return weight, np.array([np.sum(weight * np.square(left[:, r, None] - right[None, :, r])) for r in range(width)])


def _weights_and_cut(left: np.ndarray, right: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the rows of two blocks, and for each feature the weighted sum of squared differences.

    Distances and sums come from products of the matrices, the origin lying amid the rows. Where rows are
    so far out that products would lose digits, all differences are taken; so are, in the sums, those of
    rows that nearly agree.
    """
    origin = left.mean(axis=0)
    x, y = left - origin, right - origin
    xx, yy = np.square(x), np.square(y)
    a, b = xx.sum(axis=1), yy.sum(axis=1)
    largest = max(a.max(), b.max())
    if not gamma * largest * 16 * np.finfo(float).eps <= EXPONENT_ERROR:
        return _by_differences(left, right, gamma)
    distance = x @ y.T
    distance *= -2
    distance += a[:, None]
    distance += b[None, :]
    np.maximum(distance, 0, out=distance)
    close = distance <= CLOSE * largest
    if close.sum() * 256 > close.size:
        return _by_differences(left, right, gamma)
    i, j = np.nonzero(close)
    difference = np.square(x[i] - y[j])
    distance[i, j] = difference.sum(axis=1)
    weight = np.exp(-gamma * distance)
    alike = weight[i, j]
    # The rest is far enough apart for its products to keep their digits.
    weight[i, j] = 0.0
    cut = weight.sum(axis=1) @ xx + weight.sum(axis=0) @ yy - 2 * np.sum(x * (weight @ y), axis=0)
    weight[i, j] = alike
    return weight, cut + alike @ difference


def _sums_by_pairs(left: np.ndarray, right: np.ndarray, gamma: float) -> tuple[np.ndarray, ...]:
    """Of two blocks: for each feature the weighted sums of squared differences, of the squares and of the
    values of the left rows and of the right ones, and the sum of the weights.
    """
    sums = [0.0] * 6
    for begin in range(0, len(left), PIECE_ROWS):
        piece = left[begin : begin + PIECE_ROWS]
        weight, cut = _weights_and_cut(piece, right, gamma)
        rows, columns = weight.sum(axis=1), weight.sum(axis=0)
        found = cut, rows @ np.square(piece), columns @ np.square(right), rows @ piece, columns @ right, rows.sum()
        sums = [one + two for one, two in zip(sums, found, strict=True)]
    return tuple(sums)


def _orders(mixed: np.ndarray) -> list[int]:
    """How many powers of each feature the series of ``exp`` needs, whose exponent reaches ``mixed`` there."""
    least = 1e-17 * np.exp(-mixed.sum())
    orders = []
    for reach in mixed:
        term, order = 1.0, 0
        while term > least:
            order += 1
            term *= reach / order
        orders.append(order)
    return orders


def _moments(x: np.ndarray, factor: np.ndarray, gamma: float, orders: list[int]) -> np.ndarray:
    """Sums over rows of the factor times 1, each feature and its square, times all products of scaled powers."""
    powers = []
    for r, order in enumerate(orders):
        columns = np.ones((len(x), order))
        np.multiply(x[:, r, None], np.sqrt(2 * gamma / np.arange(1, order)), out=columns[:, 1:])
        powers.append(np.cumprod(columns, axis=1))
    kinds = np.concatenate([np.ones((len(x), 1)), x, np.square(x)], axis=1) * factor[:, None]
    for columns in powers[:-1]:
        kinds = (kinds[:, :, None] * columns[:, None, :]).reshape(len(x), -1)
    return (kinds.T @ powers[-1]).reshape(1 + 2 * x.shape[1], -1)


def _sums_by_moments(left: np.ndarray, right: np.ndarray, gamma: float) -> tuple[np.ndarray, ...] | None:
    """The same sums over all pairs without making a pair, or none where pairs are better.

    With ``d`` between the centres, ``u`` and ``v`` from them, a weight is a number of the left row times one of
    the right row times ``exp(2 gamma u v)``. Where blocks are narrow a few powers give that to the last digit, and
    the sums follow from the moments of each block. Digits are relative to the largest weight of the blocks, however
    small that is; where the sums are smaller by more, pairs are better, too.
    """
    width = left.shape[1]
    if width > MOMENT_FEATURES:
        return None
    low, high = (np.stack([f(left, axis=0), f(right, axis=0)]) for f in (np.min, np.max))
    centre = low + (high - low) / 2
    extent = np.maximum(high - centre, centre - low)
    mixed = 2 * gamma * extent[0] * extent[1]
    # Also where a value is not finite.
    if not mixed.sum() <= MOMENT_REACH:
        return None
    orders = _orders(mixed)
    if len(left) * len(right) * TERMS_A_PAIR < (len(left) + len(right)) * np.prod(orders):
        return None
    d, u, v = centre[0] - centre[1], left - centre[0], right - centre[1]
    half = np.square(d).sum() / 2
    one = _moments(u, np.exp(-gamma * (np.square(u).sum(axis=1) + 2 * (u @ d) + half)), gamma, orders)
    two = _moments(v, np.exp(-gamma * (np.square(v).sum(axis=1) - 2 * (v @ d) + half)), gamma, orders)
    sums = one @ two.T
    all_, u1, u2 = sums[0, 0], sums[1 : 1 + width, 0], sums[1 + width :, 0]
    v1, v2 = sums[0, 1 : 1 + width], sums[0, 1 + width :]
    both = np.diagonal(sums)[1 : 1 + width]
    cut = d * d * all_ + 2 * d * (u1 - v1) + u2 + v2 - 2 * both
    # All terms together, without their signs, are at most this; near copies leave little of them.
    size = 16 * np.finfo(float).eps * np.exp(mixed.sum()) * one[0, 0] * two[0, 0]
    if not (size <= MOMENT_ERROR * all_ and np.all(size * np.square(np.abs(d) + extent.sum(axis=0)) <= MOMENT_ERROR * cut)):
        return None
    a, b = centre
    return cut, a * a * all_ + 2 * a * u1 + u2, b * b * all_ + 2 * b * v1 + v2, a * all_ + u1, b * all_ + v1, all_


def _pair_sums(gamma: float, width: int):
    """Sums over the pairs of two blocks, one row per batch of block pairs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, square, linear, mass = np.zeros(width), np.zeros(width), np.zeros(width), 0.0
        for batch in batches:
            for left, right, same in matrices(batch, width):
                found = _sums_by_moments(left, right, gamma) or _sums_by_pairs(left, right, gamma)
                differences, left_square, right_square, left_linear, right_linear, weight = found
                # A pair of different blocks stands for both orders of its nodes.
                orders = 1.0 if same else 2.0
                cut += orders * differences / 2
                square += left_square
                linear += left_linear
                mass += orders * weight
                if not same:
                    square += right_square
                    linear += right_linear
        yield pa.RecordBatch.from_pydict(
            {"cut": [cut.tolist()], "square": [square.tolist()], "linear": [linear.tolist()], "mass": [mass]},
            schema=pa.schema(
                [
                    ("cut", pa.list_(pa.float64())),
                    ("square", pa.list_(pa.float64())),
                    ("linear", pa.list_(pa.float64())),
                    ("mass", pa.float64()),
                ]
            ),
        )

    return sums


def spec_scores(nodes: DataFrame, attributes=None, widths=None, gamma: float = 1.0) -> DataFrame:
    """``(attr, idx, score)`` of the attributes; null for a feature that does not vary.

    Every pair of nodes whose similarity is not exactly 0 in double precision is weighed, block
    by block: a task gets two blocks of rows and hands on sums per feature, never pairs. Narrow blocks of
    few features are summed by their moments, which costs rows in place of pairs.
    """
    scratch = Scratch(nodes.sparkSession, "spec")
    vectors, features = feature_vectors(nodes, attributes, widths)
    if not features:
        return nodes.sparkSession.createDataFrame([], "attr string, idx int, score double")
    pairs = block_pairs(vectors, len(features), scratch, radius=float(np.sqrt(UNDERFLOW / gamma)), centred=True)
    # Nodes are left out, as sums need no names.
    parts = pairs.select("same", "left", "right").mapInArrow(_pair_sums(gamma, len(features)), _SUMS)
    names = F.array(*(F.struct(F.lit(attr).alias("attr"), F.lit(idx).alias("idx")) for attr, idx in features))
    sums = (
        parts.select("mass", F.explode(F.arrays_zip(names.alias("feature"), "cut", "square", "linear")).alias("s"))
        .groupBy("s.feature.attr", "s.feature.idx")
        .agg(
            F.sum("s.cut").alias("cut"),
            F.sum("s.square").alias("square"),
            F.sum("s.linear").alias("linear"),
            F.sum("mass").alias("mass"),
        )
    )
    spread = F.col("square") - F.col("linear") * F.col("linear") / F.col("mass")
    varies = (F.col("square") > 0) & (spread > CONSTANT * F.col("square"))
    return sums.select(*FEATURE, F.when(varies, F.col("cut") / spread).alias("score"))
