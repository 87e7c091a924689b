"""Hard negatives by threshold joins in the manner of L2AP.

Anastasiu, Karypis: "L2AP: Fast Cosine Similarity Search With Prefix L-2 Norm Bounds" (2014).
Anchors (in blocks of at most about ``ANCHORS``) are joined with all rows by inner product of
whole-numbered vectors. Components are taken in order of falling energy over the table. A
slice of rows becomes an inverted index:

1. *suffix norms*: what follows in a row after some component adds at most the product of both
   remaining norms, so the end of a row by which alone no anchor reaches its threshold is left
   out of the index; a row all of which is such an end is not indexed at all. Rows are kept by
   falling number of indexed components, so that the list of a component is the first rows;
2. *partial scores* are accumulated over the lists, a few components at a time;
3. *pruning*: a pair stays only while partial score and remaining norms reach the threshold;
4. what is left is scored exactly (whole numbers, so no rounding decides).

Thresholds start high and are *lowered until windows fill*. First an anchor looks for its
positives, the best rows of its own label; each of them then opens a window of scores, from
``least`` to ``most`` in ``of`` parts of its own, for rows of other labels. An anchor whose windows
all have enough rows, or whose threshold is at the bottom of its lowest window, is done: all rows
at or above a threshold are known, so a full window needs nothing below it. Within a
task, thresholds rise to what its windows hold already.

Each task hands on at most as many rows of a window as the window takes; these meet in a Spark window
function. Rows are never moved, and no label, however large, is gathered anywhere. The driver
sees the anchors of one block, their positives and the number of rows in each window.

Defined results: rows with a null id or label, a null vector, or a component that is null or not
finite take no part. Rows are told apart by their ids: rows with equal ids are never each
other's positives or negatives, but else rows of their own, as anchors too. A shorter vector
counts as 0 where it ends. Positives below 0 have no window. Equal scores are ordered by id.
Integer ids. Norms whose product passes 2^53 raise. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.operators.scratch import Scratch

#: Anchors of a block, and scores worked out at once.
ANCHORS, CELLS = 8192, 1 << 21
#: Components whose lists are gone through before pairs are pruned again.
STEP = 16
#: Thresholds for positives, as parts of the largest score that the norms allow.
STARTS = (0.5, 0.25, 0.0)
#: Thresholds for negatives, as parts of the lowest positive score of an anchor; the bottom of its windows is the last.
STEPS = (0.95, 0.9, 0.85)


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, components being ``floor(scale * x)``."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return kept.select("vec_id", "label", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.ListArray, order: np.ndarray) -> np.ndarray:
    """One row per vector, components in the given order, 0 where a vector ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(len(order), 1)))
    width = int(sizes.max(initial=0))
    if width:
        at = np.arange(width)[None, :] < sizes[:, None]
        dense = np.zeros((len(column), width))
        dense[at] = column.flatten().to_numpy(zero_copy_only=False)
        out[:, : len(order)] = np.pad(dense, ((0, 0), (0, max(0, len(order) - width))))[:, order]
    return out


def _rest(matrix: np.ndarray, marks: list[int]) -> np.ndarray:
    """Norm of what follows each mark, a column for each."""
    squares = np.cumsum((matrix * matrix)[:, ::-1], axis=1)[:, ::-1]
    return np.stack([np.sqrt(squares[:, m]) if m < matrix.shape[1] else np.zeros(len(matrix)) for m in marks], axis=1)


class SliceIndex:
    """Inverted index of a slice of rows for anchors that need at least ``ratio`` times their norm."""

    def __init__(self, rows: np.ndarray, ratio: float, step: int = STEP):
        self.marks = [*range(0, rows.shape[1], step), rows.shape[1]]
        rest = _rest(rows, self.marks)
        # Rounding must not hide a row, so bounds are taken a little high everywhere.
        covered = rest * (1 + 1e-9) < ratio
        #: Lists that a row is in: those before the first mark from which its end is covered.
        lists = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.marks) - 1)
        order = np.argsort(-lists, kind="stable")
        self.place = order[: int((lists > 0).sum())]
        self.rows, self.rest, self.lists = rows[self.place], rest[self.place], lists[self.place]

    def join(self, anchors: np.ndarray, floors: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(anchor, row, score)`` of allowed pairs that reach the anchor's floor; ``allowed`` is by anchor and row."""
        rest = _rest(anchors, self.marks)
        alive = allowed[:, self.place]
        partial = np.zeros(alive.shape)
        for k, (low, high) in enumerate(zip(self.marks[:-1], self.marks[1:], strict=True)):
            many = int(np.searchsorted(-self.lists, -k, "left"))
            if not many:
                break
            partial[:, :many] += anchors[:, low:high] @ self.rows[:many, low:high].T
            bound = partial[:, :many] + rest[:, k + 1 : k + 2] * self.rest[:many, k + 1] * (1 + 1e-9) + 1e-6
            alive[:, :many] &= bound >= floors[:, None]
            if not alive[:, :many].any():
                alive[:, :many] = False
                break
        a, r = np.nonzero(alive)
        score = np.zeros(len(a))
        for low in range(0, len(a), 1 << 16):
            part = slice(low, low + (1 << 16))
            score[part] = np.einsum("ij,ij->i", anchors[a[part]], self.rows[r[part]])
        good = score >= floors[a]
        return a[good], self.place[r[good]], score[good].astype(np.int64)


@dataclass(frozen=True)
class _Block:
    """Anchors of a block with their windows of scores; what tasks are sent."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: Whether rows of the anchor's own label are looked for, or rows of others.
    same: bool
    #: A row of windows for each anchor: highest and lowest score, and whether it is still open.
    tops: np.ndarray
    bottoms: np.ndarray
    open: np.ndarray
    #: Threshold of each anchor, and rows that a window takes.
    floors: np.ndarray
    takes: int

    def active(self) -> np.ndarray:
        return np.flatnonzero(self.open.any(axis=1))


def _kept(group: np.ndarray, score: np.ndarray, key: np.ndarray, takes: int) -> np.ndarray:
    """Places of the best ``takes`` of each group, in order of group and rank."""
    order = np.lexsort((key, -score, group))
    ordered = group[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    rank = np.arange(len(ordered)) - np.repeat(first, np.diff(first, append=len(ordered)))
    return order[rank < takes]


def _joined(rows: DataFrame, block: _Block, order: np.ndarray) -> DataFrame:
    """``(anchor, w, vec_id, score, n)``: the best rows of each open window, and how many there are.

    ``anchor`` is the place in the block, ``w`` the window.
    """
    used = block.active()
    takes, windows = block.takes, block.tops.shape[1]
    ids, labels, vectors, floors = block.ids[used], block.labels[used], block.vectors[used], block.floors[used]
    tops, bottoms, opened, same = block.tops[used], np.maximum(block.bottoms[used], floors[:, None]), block.open[used], block.same
    norms = np.linalg.norm(vectors, axis=1)
    schema = "anchor int, w int, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        needed = floors.astype(float)
        step = max(16, CELLS // len(used))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                keys = batch["vec_id"].to_numpy().astype(np.int64)
                alike = labels[:, None] == np.array(batch["label"].to_pylist())[None, :]
                allowed = (alike if same else ~alike) & (ids[:, None] != keys[None, :])
                # Anchors without length reach nothing above 0 and everything else.
                ratio = np.where(norms > 0, needed / np.where(norms > 0, norms, 1), np.where(needed > 0, np.inf, -np.inf))
                index = SliceIndex(_matrix(batch["v"], order), float(ratio.min()))
                anchor, row, score = index.join(vectors, needed, allowed)
                inside = opened[anchor] & (score[:, None] <= tops[anchor]) & (score[:, None] >= bottoms[anchor])
                pair, w = np.nonzero(inside)
                if not len(pair):
                    continue
                held = [np.concatenate(both) for both in zip(held, (anchor[pair] * windows + w, score[pair], keys[row[pair]]), strict=True)]
                best = _kept(held[0], held[1], held[2], takes)
                held = [column[best] for column in held]
                # A full window needs nothing below its last row, an anchor nothing below its lowest open window.
                full, count = np.unique(held[0], return_counts=True)
                last = np.cumsum(count) - 1
                reached = np.where(opened, bottoms, np.inf).astype(float).ravel()
                enough = count == takes
                reached[full[enough]] = held[1][last[enough]]
                needed = np.maximum(needed, reached.reshape(opened.shape).min(axis=1))
        if len(held[0]):
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(used[held[0] // windows].astype(np.int32)),
                    "w": pa.array((held[0] % windows).astype(np.int32)),
                    "vec_id": pa.array(held[2]),
                    "score": pa.array(held[1]),
                }
            )

    found = rows.mapInArrow(run, schema)
    best = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= takes)
    return ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor", "w")))


def _positives(rows: DataFrame, block: _Block, order: np.ndarray, largest: float, scratch: Scratch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (-1: none) of the positives of each anchor that score at least 0."""
    count, takes = len(block.ids), block.takes
    ids, scores = np.zeros((count, takes), np.int64), np.full((count, takes), -1, np.int64)
    norms = np.linalg.norm(block.vectors, axis=1)
    for number, part in enumerate(STARTS):
        block = replace(block, floors=np.floor(part * norms * largest).astype(np.int64))
        # At most ``takes`` rows for each anchor of the block.
        found = scratch.save(_joined(rows, block, order), f"{name}-{number}").toPandas()
        place, rank = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1
        ids[place, rank], scores[place, rank] = found["vec_id"], found["score"]
        scratch.drop(f"{name}-{number}")
        block = replace(block, open=(scores[:, -1:] < 0))
        if not block.open.any():
            break
    return ids, scores


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, of: int = 100, block_anchors: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are ``(vec_id, label, v)`` with whole-numbered vectors, see :func:`quantized`;
    ``anchors`` says which of them are anchors.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    stored = scratch.save(rows.select("vec_id", "label", "v", F.coalesce(anchors, F.lit(False)).alias("_anchor"), F.monotonically_increasing_id().alias("_row")), "rows")
    square = F.aggregate("v", F.lit(0.0), lambda total, e: total + e.cast("double") * e.cast("double"))
    count, largest = stored.agg(F.count_if("_anchor"), F.max(square)).first()
    largest = math.sqrt(largest or 0.0)
    if largest * largest >= 2.0**53:
        raise ArithmeticError("vectors too long for exact inner products")
    # One row for each component.
    energy = stored.select(F.posexplode("v").alias("i", "e")).groupBy("i").agg(F.sum(F.col("e").cast("double") * F.col("e")).alias("energy")).collect()
    order = np.array([row["i"] for row in sorted(energy, key=lambda row: (-row["energy"], row["i"]))], np.int64)
    candidates = stored.select("vec_id", "label", "v")
    blocks = max(1, -(-count // block_anchors))
    parts = 0
    for number in range(blocks):
        chosen = stored.where("_anchor")
        if blocks > 1:
            chosen = chosen.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == number)
        # The anchors of a block: about ``block_anchors``.
        table = chosen.select("vec_id", "label", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        labels = np.array(table["label"].to_pylist())
        none = np.zeros((table.num_rows, 1), np.int64)
        start = _Block(
            table["vec_id"].to_numpy().astype(np.int64), labels, _matrix(table["v"], order), True,
            none + (1 << 62), none, np.ones(none.shape, bool), none[:, 0], positives,
        )
        ids, scores = _positives(candidates, start, order, largest, scratch, f"positives-{number}")
        bottoms = -(-least * scores // of)
        block = replace(start, same=False, tops=most * scores // of, bottoms=bottoms, open=scores >= 0, takes=negatives)
        lowest = np.where(scores >= 0, scores, np.iinfo(np.int64).max).min(axis=1)
        bottom = np.where(scores >= 0, bottoms, np.iinfo(np.int64).max).min(axis=1)
        for part in (*STEPS, None):
            if not block.open.any():
                break
            floors = bottom if part is None else np.maximum(bottom, (lowest * part).astype(np.int64))
            block = replace(block, floors=floors)
            path = f"found/part={parts}"
            parts += 1
            found = scratch.save(_final(_joined(candidates, block, order), block, ids, scores), path)
            # One row for each window that got something.
            full = found.where("full").select("anchor", "w").distinct().toPandas()
            done = block.open & (block.bottoms >= floors[:, None])
            done[full["anchor"], full["w"]] = True
            block = replace(block, open=block.open & ~done)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kept = spark.read.schema(found.schema).parquet(f"{scratch.base}/found/*").where("full or last")
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _final(found: DataFrame, block: _Block, ids: np.ndarray, scores: np.ndarray) -> DataFrame:
    """Rows of windows with their anchor and positive; ``full``, or ``last`` where nothing more can come."""
    anchors, takes = block.ids, block.takes
    last = block.bottoms >= block.floors[:, None]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, w = batch["anchor"].to_numpy(), batch["w"].to_numpy()
            columns = {
                "anchor": batch["anchor"],
                "w": batch["w"],
                "anchor_id": pa.array(anchors[a]),
                "positive_id": pa.array(ids[a, w]),
                "rank": batch["rank"].cast(pa.int32()),
                "negative_id": batch["vec_id"],
                "positive_score": pa.array(scores[a, w]),
                "negative_score": batch["score"],
                "full": pa.array(batch["n"].to_numpy() == takes),
                "last": pa.array(last[a, w]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return found.mapInArrow(
        name,
        "anchor int, w int, anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, full boolean, last boolean",
    )
