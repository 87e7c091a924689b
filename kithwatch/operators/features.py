"""Node attributes as a long table of numeric features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that identify a node and are never a feature.
RESERVED = ("nodeId", "id", "community")
# Position of a feature that is a plain number rather than an element of a vector.
SCALAR = -1
# Community of the nodes that have none, where a partition of all nodes is needed.
UNASSIGNED = -1

_WHOLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and _is_number(kind.elementType)


def attribute_columns(nodes: DataFrame) -> list[str]:
    """Columns that hold a number or a vector of numbers, identifiers left out."""
    return [
        field.name
        for field in nodes.schema.fields
        if field.name not in RESERVED and (_is_number(field.dataType) or is_vector(field.dataType))
    ]


def vector_widths(nodes: DataFrame, attributes: Iterable[str]) -> dict[str, int]:
    """Length of the longest vector of each vector attribute."""
    vectors = [a for a in attributes if is_vector(nodes.schema[a].dataType)]
    if not vectors:
        return {}
    longest = nodes.agg(*(F.max(F.size(F.col(f"`{a}`"))).alias(f"w{i}") for i, a in enumerate(vectors))).first()
    return {a: max(longest[i] or 0, 0) for i, a in enumerate(vectors)}


def feature_table(
    nodes: DataFrame,
    attributes: Iterable[str] | None = None,
    widths: Mapping[str, int] | None = None,
) -> DataFrame:
    """``(node, attr, idx, value, whole, exact)``: one row per node and feature.

    A vector gives one feature per position, up to the longest vector of the attribute; a
    missing number or position counts as 0. ``whole`` marks attributes of integer type, whose
    value is also in ``exact``, as doubles hold no whole numbers beyond 2^53; it is 0 for all others.
    Columns ``community`` of ``nodes`` are carried along.
    """
    names = attribute_columns(nodes) if attributes is None else list(attributes)
    unknown = [a for a in names if a not in attribute_columns(nodes)]
    if unknown:
        raise ValueError(f"not numeric attributes of the nodes: {unknown}")
    widths = dict(widths) if widths is not None else vector_widths(nodes, names)

    def entry(attribute: str, position, value):
        kind = nodes.schema[attribute].dataType
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return F.struct(
            F.lit(attribute).alias("attr"),
            F.lit(position).cast("int").alias("idx"),
            F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"),
            F.lit(isinstance(element, _WHOLE)).alias("whole"),
            (F.coalesce(value.cast("long"), F.lit(0)) if isinstance(element, _WHOLE) else F.lit(0).cast("long")).alias("exact"),
        )

    def elements(attribute: str):
        column = F.col(f"`{attribute}`")
        positions = F.sequence(F.lit(0), F.lit(widths[attribute] - 1))
        return F.transform(positions, lambda i: entry(attribute, i, F.get(column, i)))

    parts = []
    for name in names:
        if not is_vector(nodes.schema[name].dataType):
            parts.append(F.array(entry(name, SCALAR, F.col(f"`{name}`"))))
        elif widths[name]:
            parts.append(elements(name))
    carried = ["community"] if "community" in nodes.columns else []
    if not parts:
        parts = [F.array().cast("array<struct<attr:string,idx:int,value:double,whole:boolean,exact:bigint>>")]
    return nodes.select(
        F.col("id").alias("node"), *carried, F.explode(F.concat(*parts)).alias("feature")
    ).select("node", *carried, "feature.*")


def with_community(nodes: DataFrame, communities: DataFrame, how: str = "inner") -> DataFrame:
    """Nodes with their community, replacing a column of that name.

    ``how="left"`` keeps nodes without one in a pseudo-community of their own.
    """
    labels = communities.select(F.col("node").alias("id"), "community")
    joined = nodes.drop("community").join(labels, "id", how)
    return joined.withColumn("community", F.coalesce("community", F.lit(UNASSIGNED))) if how == "left" else joined


def top_features(ranked: DataFrame, percentile: float) -> list[tuple[str, int]]:
    """The best ``max(1, int(percentile * count))`` features of a table with a ``rank``.

    One row per feature, so the table is as small as the schema of the nodes.
    """
    rows = ranked.orderBy("rank").select("attr", "idx").collect()
    return [(row.attr, row.idx) for row in rows[: max(1, int(len(rows) * percentile))]]


def keep_features(features: DataFrame, selected: Iterable[tuple[str, int]]) -> DataFrame:
    """Rows of the selected features only."""
    kept = F.lit(False)
    for attr, idx in selected:
        kept = kept | ((F.col("attr") == attr) & (F.col("idx") == idx))
    return features.where(kept)
