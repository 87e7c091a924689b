"""Joins and ordered windows that no single hot key can overload.

Two session settings say how much one task may get:

* ``spark.kithwatch.hotRows``: rows of one join key beyond which it is split;
* ``spark.kithwatch.windowRows``: rows of one window group beyond which it is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithwatch.operators.scratch import Scratch

HOT_ROWS = 1_000_000
WINDOW_ROWS = 1_000_000
#: Buckets that keys are counted in first.
BUCKETS = 1 << 14


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.kithwatch.hotRows", str(HOT_ROWS)))


def window_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.kithwatch.windowRows", str(WINDOW_ROWS)))


def hot_keys(facts: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Keys too frequent for one task, with the number of pieces each is split into.

    There are at most ``rows / hotRows`` of them and as many pieces, whatever the data, so
    the table may be broadcast. ``weight`` gives the rows a line of ``facts`` stands for.

    Rows are counted in buckets first, a few numbers a task; only keys of buckets beyond the limit,
    of which there are as few, are counted one by one.
    """
    limit = hot_rows(facts.sparkSession)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    bucketed = facts.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    crowded = bucketed.groupBy("_bucket").agg(rows.alias("_rows")).where(F.col("_rows") > limit).select("_bucket")
    return (
        bucketed.join(F.broadcast(crowded), "_bucket", "left_semi")
        .groupBy(*keys)
        .agg(rows.alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_pieces"))
    )


def pieces_of(counts: DataFrame, key: str, rows: str) -> DataFrame:
    """The same from a table that has the ``rows`` of each key already."""
    limit = hot_rows(counts.sparkSession)
    busy = counts.where(F.col(rows) > limit)
    return busy.select(key, F.ceil(F.col(rows) / limit).cast("int").alias("_pieces"))


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to a table by key, splitting hot keys of ``facts``.

    Rows of a hot key go to one of its pieces by a hash of ``spread_by`` (columns that tell
    the rows of a key apart), and what the dimension holds of the key is copied to each
    piece. A hash, unlike a random salt, gives the same piece when a lost task is run again.

    ``rows`` is an upper bound of the rows of ``facts``, where the caller knows one: few
    rows cannot hold a hot key, and need no search for any. ``hot`` gives the hot keys, if
    the caller has them from :func:`hot_keys`.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if rows is not None and rows <= hot_rows(facts.sparkSession):
        return facts.join(dimension, keys, how)
    if hot is None:
        hot = hot_keys(facts, keys)
    piece = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_pieces")).cast("int"), F.lit(0))
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    spread = facts.join(F.broadcast(hot), keys, "left").withColumn("_piece", piece).drop("_pieces")
    copies = dimension.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return spread.join(copies, [*keys, "_piece"], how).drop("_piece")


def stored_if_large(table: DataFrame, rows: int, scratch: Scratch, name: str) -> DataFrame:
    """The table, written where :func:`lookup` would search it for hot keys and so work it out again."""
    return scratch.save(table, name) if rows > hot_rows(table.sparkSession) else table


def largest_group(table: DataFrame, group: Sequence[str]) -> int:
    return table.groupBy(*group).count().agg(F.max("count").alias("n")).first().n or 0


def _by_range(
    table: DataFrame, group: Sequence[str], order: Sequence[str], scratch: Scratch, name: str, rows: int = 0
) -> DataFrame:
    """The table cut into key ranges, ``_chunk`` numbering them in key order.

    There are as many ranges as shuffle partitions, and more where ``rows`` need them to stay
    below the window limit; a given number is not merged at run time. Written out, so that the
    chunk of a row stays the same however often it is read.
    """
    spark = table.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // window_rows(spark)))
    ranged = table.repartitionByRange(parts, *group, *order).withColumn("_chunk", F.spark_partition_id())
    return scratch.save(ranged, name)


def running_total(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    weight: str,
    into: str,
    total: str,
    scratch: Scratch,
    name: str,
    largest: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` up to and including each row, and over its whole group.

    ``group`` and ``order`` together must tell rows of non-zero weight apart. Groups that
    fit a task use a plain window. Otherwise the rows are range-partitioned, each range is
    summed on its own, and the totals of the ranges before it (a handful of rows per group)
    are added. ``largest`` is the size of the largest group, if the caller knows it.
    """
    if largest is None:
        largest = largest_group(table, group)
    if largest <= window_rows(table.sparkSession):
        whole = Window.partitionBy(*group)
        so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumn(into, F.sum(weight).over(so_far)).withColumn(total, F.sum(weight).over(whole))
    chunks = _by_range(table, group, order, scratch, name, table.count())
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.groupBy(*group, "_chunk")
        .agg(F.sum(weight).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn(total, F.sum("_sum").over(Window.partitionBy(*group)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunks.join(offsets, [*group, "_chunk"])
        .withColumn(into, F.sum(weight).over(inside) + F.col("_offset"))
        .drop("_chunk", "_offset")
    )


def next_value(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    into: str,
    scratch: Scratch,
    name: str,
) -> DataFrame:
    """The ``value`` of the following row of the group, null at its end."""
    if largest_group(table, group) <= window_rows(table.sparkSession):
        return table.withColumn(into, F.lead(value).over(Window.partitionBy(*group).orderBy(*order)))
    chunks = _by_range(table, group, order, scratch, name, table.count())
    following = Window.partitionBy(*group).orderBy("_chunk")
    # The value is wrapped so that a following null is told apart from no following row.
    heads = (
        chunks.groupBy(*group, "_chunk")
        .agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_head"))
        .withColumn("_after", F.lead("_head").over(following))
        .drop("_head")
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (
        chunks.join(heads, [*group, "_chunk"])
        .withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
        .withColumn(into, F.coalesce("_next", "_after")["v"])
        .drop("_chunk", "_after", "_next")
    )


def dense_ids(keys: DataFrame, key: str, into: str, scratch: Scratch, name: str) -> DataFrame:
    """Number distinct keys 0, 1, 2, ... in key order without a global window."""
    return numbered(keys.select(key), [key], into, scratch, name)


#: A row's place in its task is in so many lower bits of ``monotonically_increasing_id``, the task above them.
PLACE_BITS = 33


def ordered(table: DataFrame, order: Sequence[str], into: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows with a number that follows an order that tells them apart, but leaves gaps; written out.

    Each task sorts a range of the keys and numbers its rows as it writes them, so they are shuffled once.
    No window holds a range, so its rows need no limit and small ranges may be merged at run time.
    """
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(ranged.withColumn(into, F.monotonically_increasing_id()), name)


def numbered(table: DataFrame, order: Sequence[str], into: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows with their place, from 0, in an order that tells them apart."""
    chunks = ordered(table, order, "_at", scratch, name).withColumn("_chunk", F.shiftright("_at", PLACE_BITS))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so this window is as small as the number of partitions.
    offsets = (
        chunks.groupBy("_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return chunks.join(F.broadcast(offsets), "_chunk").withColumn(into, place + F.col("_offset")).drop("_at", "_chunk", "_offset")
