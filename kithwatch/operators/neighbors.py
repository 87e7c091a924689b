"""Affinity of each node to its most similar nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kithwatch.operators.row_blocks import block_pairs, feature_vectors, matrices
from kithwatch.operators.scratch import Scratch

# Fixed value: vectors shorter than this are not stretched to length 1.
LEAST_LENGTH = 1e-12
#: Similarities that agree to so many digits are equal.
DIGITS = 12
# Rows of a block that are compared with as many others at a time.
PIECE_ROWS = 512
# Pairs for each of the k best that are worked out one by one.
FEW = 8


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.square(rows).sum(axis=1)), LEAST_LENGTH)[:, None]


def _first_best(similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row, of equal ones the first."""
    # All that reach the k-th best similarity; of those equal to it the first nodes fill up to k.
    last = similarity.shape[1] - min(k, similarity.shape[1])
    bound = np.partition(similarity, last, axis=1)[:, last, None]
    above = similarity > bound
    equal = (similarity == bound) & (similarity > -np.inf)
    equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]
    return np.nonzero(above | equal)


class _Best:
    """The k best of the columns that each row was offered; columns are numbered in the order of their nodes."""

    def __init__(self, rows: int, k: int, width: int):
        self.k = k
        self.similarity = np.full((rows, k), -np.inf)
        self.at = np.full((rows, k), np.iinfo(np.int64).max)
        # Twice what single precision can be off by.
        self.slack = (width + 4) * float(np.finfo(np.float32).eps) + 10.0**-DIGITS

    def offer(self, near: np.ndarray, x: np.ndarray, y: np.ndarray, row: int, column: int, alone: bool) -> None:
        """Similarities in single precision of the rows ``x`` from ``row`` and ``y`` from ``column`` on.

        They tell which pairs cannot be among the best; the others are worked out again. ``alone`` says
        that both are the same rows.
        """
        worst, last = self.similarity[row : row + len(x), -1], self.at[row : row + len(x), -1]
        few = FEW * self.k * len(x)
        cut = (worst - self.slack).astype(np.float32)
        mask = near >= cut[:, None]
        if np.count_nonzero(mask) > few and near.shape[1] > self.k:
            reached = np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k]
            mask = near >= np.maximum(cut, reached - np.float32(2 * self.slack))[:, None]
        if alone:
            np.fill_diagonal(mask, False)
        found = np.count_nonzero(mask)
        if not found:
            return
        if found <= few:
            # Read as one row and in the order it lies in memory, which is several times as fast.
            if mask.flags.c_contiguous:
                rows, columns = np.divmod(np.flatnonzero(mask), len(y))
            else:
                columns, rows = np.divmod(np.flatnonzero(mask.T), len(x))
            similarity = np.round(np.einsum("ij,ij->i", x[rows], y[columns]), DIGITS)
            behind, first = worst[rows], column + columns < last[rows]
            better = (similarity > behind) | ((similarity == behind) & first)
            rows, columns, similarity = rows[better], columns[better], similarity[better]
        else:
            # Many agree so closely, which no more than k of each row may leave.
            exact = np.round(x @ y.T, DIGITS)
            better = exact > worst[:, None]
            if column < last.max():
                better |= (exact == worst[:, None]) & (np.arange(column, column + len(y)) < last[:, None])
            exact[~better] = -np.inf
            if alone:
                np.fill_diagonal(exact, -np.inf)
            rows, columns = _first_best(exact, self.k)
            similarity = exact[rows, columns]
        self._merge(row + rows, column + columns, similarity)

    def _merge(self, rows: np.ndarray, columns: np.ndarray, similarity: np.ndarray) -> None:
        known, counts = np.unique(rows, return_counts=True)
        row = np.concatenate([np.repeat(known, self.k), rows])
        at = np.concatenate([self.at[known].ravel(), columns])
        similarity = np.concatenate([self.similarity[known].ravel(), similarity])
        order = np.lexsort((at, -similarity, row))
        counts = counts + self.k
        begins = np.repeat(np.cumsum(counts) - counts, counts)
        order = order[np.arange(len(order)) - begins < self.k]
        self.at[known] = at[order].reshape(-1, self.k)
        self.similarity[known] = similarity[order].reshape(-1, self.k)


def _closest(k: int, width: int, node_type: pa.DataType):
    """Candidates of both blocks of a pair: the k best rows of the other block.

    Similarities are rounded first and equal ones go to the smaller node, as in the end, so a
    block hands on k rows for each node and never drops one that belongs to its best.
    """
    schema = pa.schema([("i", node_type), ("j", node_type), ("similarity", pa.float64())])

    def in_order(rows: np.ndarray, nodes: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Rows of length 1 and their nodes, in the order of these; a row that is not finite is like no other."""
        order = pc.sort_indices(nodes, null_placement="at_start").to_numpy()
        rows = _unit(rows[order])
        finite = np.isfinite(rows).all(axis=1)
        return rows[finite], nodes.take(pa.array(order[finite]))

    def handed_on(best: _Best, own: pa.Array, other: pa.Array) -> pa.RecordBatch:
        rows, places = np.nonzero(best.similarity > -np.inf)
        columns = best.at[rows, places]
        return pa.RecordBatch.from_arrays(
            [own.take(pa.array(rows)), other.take(pa.array(columns)), pa.array(best.similarity[rows, places])],
            schema=schema,
        )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (left, right, same) in enumerate(matrices(batch, width)):
                x, own = in_order(left, batch.column("left_nodes")[row].values)
                y, other = (x, own) if same else in_order(right, batch.column("right_nodes")[row].values)
                best = _Best(len(x), k, width)
                best_other = best if same else _Best(len(y), k, width)
                short_x = x.astype(np.float32)
                short_y = short_x if same else y.astype(np.float32)
                for i in range(0, len(x), PIECE_ROWS):
                    for j in range(i if same else 0, len(y), PIECE_ROWS):
                        a, b = slice(i, i + PIECE_ROWS), slice(j, j + PIECE_ROWS)
                        near = short_x[a] @ short_y[b].T
                        alone = same and i == j
                        if alone:
                            np.fill_diagonal(near, -np.inf)
                        best.offer(near, x[a], y[b], i, j, alone)
                        if not alone:
                            best_other.offer(near.T, y[b], x[a], j, i, alone)
                yield handed_on(best, own, other)
                if not same:
                    yield handed_on(best_other, other, own)

    return candidates


def nearest_affinity(nodes: DataFrame, attributes=None, widths=None, k: int = 5) -> DataFrame:
    """``(i, j, weight)`` linking each node to itself and its ``k`` most similar others.

    Similarity is the cosine of the attribute vectors, equal ones going to the smaller
    node; a link holds both ways and weighs 1. Of every block pair only the best candidates
    leave the task.
    """
    scratch = Scratch(nodes.sparkSession, "nearest")
    vectors, features = feature_vectors(nodes, attributes, widths)
    node_type = nodes.schema["id"].dataType
    pairs = block_pairs(vectors, len(features), scratch)
    candidates = pairs.mapInArrow(
        _closest(k, len(features), to_arrow_type(node_type)),
        f"i {node_type.simpleString()}, j {node_type.simpleString()}, similarity double",
    )
    place = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    chosen = candidates.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("i", "j")
    links = (
        chosen.unionByName(chosen.select(F.col("j").alias("i"), F.col("i").alias("j")))
        .unionByName(vectors.select(F.col("node").alias("i"), F.col("node").alias("j")))
        .distinct()
        .withColumn("weight", F.lit(1.0))
    )
    # Written, so that whoever joins the links does not compare all nodes again.
    return scratch.save(links, "links")
