"""Rows gathered into blocks, for work on all pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.operators.features import SCALAR, attribute_columns, is_vector, vector_widths
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import running_total

# Most rows of one block: two blocks and the matrix of their pairs must fit a task.
BLOCK_ROWS = 2048
# The same and most bytes of a block where all are compared with all, piece by piece: larger ones travel less often.
WHOLE_ROWS = 1 << 16
WHOLE_BYTES = 16 << 20
# Tasks over which the pairs of one of these are dealt.
TURNS = 4
LEAST_BLOCK_ROWS = 64


def feature_vectors(nodes: DataFrame, attributes=None, widths=None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``(node, vector)`` with all features of a node in one array, and their names in order."""
    names = attribute_columns(nodes) if attributes is None else list(attributes)
    widths = dict(widths) if widths is not None else vector_widths(nodes, names)
    parts, features = [], []
    for name in names:
        column = F.col(f"`{name}`")
        if is_vector(nodes.schema[name].dataType):
            values = [F.get(column, F.lit(i)) for i in range(widths[name])]
            features += [(name, i) for i in range(widths[name])]
        else:
            values = [column]
            features.append((name, SCALAR))
        parts += [F.coalesce(value.cast("double"), F.lit(0.0)) for value in values]
    return nodes.select(F.col("id").alias("node"), F.array(*parts).alias("vector")), features


def _shape(vectors: DataFrame, width: int, inner: bool) -> tuple[int, list[int], list[float], list[float]]:
    """Number of rows, positions of the features from the widest on, and range and mean of every feature.

    The ``inner`` range leaves the outermost twentieths out, so that a few far rows do not decide it.
    """
    whole = F.max("x") - F.min("x")
    ends = F.percentile_approx("x", [0.05, 0.95], 1000)
    row = (
        vectors.select(F.posexplode("vector").alias("at", "x"))
        .groupBy("at")
        .agg(F.count(F.lit(1)).alias("n"), (ends[1] - ends[0] if inner else whole).alias("range"), F.avg("x").alias("mean"))
        .orderBy("at")
        .collect()
    )
    # One row per feature, so this is as small as the schema of the nodes.
    if not row:
        return 0, [0], [0.0] * width, [0.0] * width
    ranges = [r["range"] for r in row]
    return row[0]["n"], sorted(range(width), key=lambda r: -ranges[r]), ranges, [r["mean"] for r in row]


def _slabs(blocks: int, wide: float, narrow: float) -> int:
    """Into how many slabs of the widest feature blocks go that are about as long as wide."""
    if not (math.isfinite(wide) and math.isfinite(narrow)) or narrow <= 0:
        return max(1, blocks)
    return max(1, min(blocks, round(math.sqrt(blocks * wide / narrow))))


def block_pairs(
    vectors: DataFrame, width: int, scratch: Scratch, radius: float | None = None, centred: bool = False
) -> DataFrame:
    """All pairs of blocks ``(same, left, right, left_nodes, right_nodes)``, each pair once.

    Blocks follow the widest feature and, inside a slab of it, the next one. With a ``radius``
    blocks are about as long as wide in these two, and only pairs of blocks are made whose bounds in all
    features come that close; without one, all are. ``centred`` shifts every feature to a mean of 0, which leaves differences as they are.

    Which block of a pair is the left one alternates, so that every block is looked up about as
    often, and the number of tasks does not depend on how few bytes the pairs have.
    """
    count, widest, ranges, means = _shape(vectors, width, radius is not None)
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    most = BLOCK_ROWS if radius is not None else max(BLOCK_ROWS, min(WHOLE_ROWS, WHOLE_BYTES // (8 * max(1, width))))
    rows = max(LEAST_BLOCK_ROWS, min(most, -(-count // (2 * tasks))))
    shift = F.array(*(F.lit(m if centred else 0.0) for m in means))
    keyed = vectors.select(
        "node",
        F.zip_with("vector", shift, lambda x, m: x - m).alias("vector"),
        F.get("vector", F.lit(widest[0])).alias("key"),
        F.get("vector", F.lit(widest[-1] if radius is None else widest[min(1, width - 1)])).alias("next"),
    )
    # Ordered by node within equal keys, so that a frequent value can be cut as well.
    if radius is None:
        ranged = keyed.repartitionByRange("key", "node")
    else:
        narrow = ranges[widest[1]] if width > 1 else 0.0
        ranged = keyed.repartitionByRange(_slabs(-(-count // rows), ranges[widest[0]], narrow), "key", "node")
    ranged = ranged.withColumn("chunk", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    inside = ["key", "node"] if radius is None else ["next", "key", "node"]
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(*inside)) - 1
    bound = lambda of: F.array(*(of(F.get("vector", F.lit(r))) for r in range(width)))
    blocks = (
        ranged.withColumn("part", F.floor(place / rows))
        .groupBy("chunk", "part")
        .agg(
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            bound(F.min).alias("least"),
            bound(F.max).alias("most"),
            F.collect_list(F.struct("node", "vector")).alias("members"),
        )
        .withColumn("matrix", F.flatten("members.vector"))
        .withColumn("nodes", F.col("members.node"))
        .withColumn("one", F.lit(1).cast("long"))
        .drop("members")
    )
    blocks = scratch.save(blocks, "blocks")
    bounds = blocks.select("chunk", "part", "least", "most", "one")
    slabs = blocks.groupBy("chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = bounds.join(slabs, "chunk")
    numbered = running_total(bounds, [], ["chunk", "part"], "one", "upto", "all", scratch, "numbered")
    numbered = scratch.save(numbered.withColumn("block", F.col("upto") - 1), "numbers")
    if radius is None:
        reach = numbered.select("block", (F.col("all") - 1).alias("last"))
    else:
        # How many blocks lie in slabs that begin before the end of this one's reach.
        marks = numbered.select(
            "block",
            F.explode(
                F.array(
                    F.struct(F.col("low").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("begins")),
                    F.struct((F.col("high") + radius).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("begins")),
                )
            ).alias("mark"),
        ).select("block", "mark.*")
        reached = running_total(marks, [], ["at", "kind", "block"], "begins", "begun", "all", scratch, "reach")
        reach = reached.where(F.col("kind") == 1).select("block", (F.col("begun") - 1).alias("last"))
    known = blocks.join(numbered.select("chunk", "part", "block"), ["chunk", "part"]).select("block", "matrix", "nodes")
    known = scratch.save(known, "known")
    pairs = reach.select("block", F.explode(F.sequence("block", "last")).alias("other"))
    if radius is not None:
        pairs = _within(pairs, numbered, radius)
    turned = (F.col("block") + F.col("other")) % 2 == 1
    pairs = pairs.select(
        F.when(turned, F.col("other")).otherwise(F.col("block")).alias("block"),
        F.when(turned, F.col("block")).otherwise(F.col("other")).alias("other"),
    )
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = known.select("block", F.col("matrix").alias("left"), F.col("nodes").alias("left_nodes"))
    right = known.select(F.col("block").alias("other"), F.col("matrix").alias("right"), F.col("nodes").alias("right_nodes"))
    keys = ["other"]
    if radius is None:
        # Few large blocks, each with very many pairs of rows, so a task gets a few pairs of blocks only.
        keys = ["other", "turn"]
        pairs = pairs.withColumn("turn", F.col("block") % TURNS)
        right = right.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1)).cast("array<bigint>")))
        tasks = max(tasks, 2 * TURNS * -(-count // rows))
    return (
        pairs.join(left, "block")
        .repartition(tasks, *keys)
        .join(right.repartition(tasks, *keys), keys)
        .select((F.col("block") == F.col("other")).alias("same"), "left", "right", "left_nodes", "right_nodes")
    )


def _within(pairs: DataFrame, bounds: DataFrame, radius: float) -> DataFrame:
    """The pairs of blocks whose bounds leave a distance of at most ``radius``; unknown distances stay."""
    one = bounds.select("block", F.col("least").alias("least_a"), F.col("most").alias("most_a"))
    two = bounds.select(F.col("block").alias("other"), F.col("least").alias("least_b"), F.col("most").alias("most_b"))
    apart = F.zip_with(
        F.zip_with("least_b", "most_a", lambda low, high: low - high),
        F.zip_with("least_a", "most_b", lambda low, high: low - high),
        lambda a, b: F.greatest(a, b, F.lit(0.0)),
    )
    square = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)
    near = (square <= radius * radius) | F.isnan(square)
    return pairs.join(one, "block").join(two, "other").where(near).select("block", "other")


def matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The two matrices of every block pair of a batch, and whether they are the same block."""
    same, left, right = batch.column("same"), batch.column("left"), batch.column("right")
    for row in range(batch.num_rows):
        yield (
            left[row].values.to_numpy(zero_copy_only=False).reshape(-1, width),
            right[row].values.to_numpy(zero_copy_only=False).reshape(-1, width),
            same[row].as_py(),
        )
