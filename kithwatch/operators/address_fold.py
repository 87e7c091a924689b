"""Users of an address network that grows: only what new transactions touch is worked out.

A user is named after its smallest address, a name that does not depend on the order in which
transactions come. Folding new links in

1. ties an address known before to its user by one more link;
2. runs connected components over the touched users and the addresses of the load only;
3. gives the users that became another one as a table of changes (user, into).

Tables keyed by users need no rewriting for a change; :func:`resolved` applies the changes when
they are read. Changes are kept resolved themselves: ``into`` is never the ``user`` of another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.graph import Graph
from kithwatch.operators.components import connected_components
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import dense_ids, lookup


@dataclass(frozen=True)
class UserFold:
    """``placed`` (address, user) of the folded addresses and of those that touched users are named after, the new ones, and all changes so far."""

    placed: DataFrame
    additions: DataFrame
    changes: DataFrame


def resolved(table: DataFrame, column: str, changes: DataFrame, spread_by: list[str], rows: int | None = None) -> DataFrame:
    """The table with the users of a column replaced by what they have become."""
    known = changes.select(F.col("user").alias(column), "into")
    columns = [F.coalesce("into", column).alias(column) if name == column else F.col(name) for name in table.columns]
    return lookup(table, known, column, spread_by, how="left", rows=rows).select(*columns)


def fold_users(members: DataFrame, changes: DataFrame, addresses: Graph, scratch: Scratch, links: DataFrame | None = None) -> UserFold:
    """Place the addresses of new transactions.

    ``members`` are ``(address, user)`` of all addresses before, ``changes`` the changes that
    these users have gone through, ``addresses`` the network of the new transactions alone.
    ``links`` (src, dst) join the same addresses as its edges, where the caller has them.
    """
    nodes = addresses.nodes.select("id")
    links = (addresses.edges if links is None else links).select("src", "dst")
    known = members.join(nodes.withColumnRenamed("id", "address"), "address", "left_semi")
    known = scratch.save(resolved(known, "user", changes, ["address"]), "known")
    if known.isEmpty():
        placed = scratch.save(connected_components(nodes, links).toDF("address", "user"), "placed")
        return UserFold(placed, placed, changes)
    # A user is named after its smallest address, so the smallest name is that of the smallest address.
    grown = known.select(F.col("user").alias("id")).distinct()
    ties = known.select(F.col("address").alias("src"), F.col("user").alias("dst"))
    parts = scratch.save(connected_components(nodes.unionByName(grown), links.unionByName(ties)), "parts")
    placed = parts.toDF("address", "user")
    old = known.select("address").unionByName(grown.toDF("address"))
    moved = parts.where(F.col("id") != F.col("component")).join(grown, "id", "left_semi")
    moved = scratch.save(moved.select(F.col("id").alias("user"), F.col("component").alias("into")), "moved")
    older = resolved(changes.select(F.col("user").alias("was"), F.col("into").alias("user")), "user", moved.select("user", "into"), ["was"])
    every = older.select(F.col("was").alias("user"), F.col("user").alias("into")).unionByName(moved)
    return UserFold(placed, placed.join(old, "address", "left_anti"), every)


def numbered_users(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``(user, user_id)``: users of resolved ``members`` numbered by their smallest address."""
    names = members.where(F.col("address") == F.col("user")).select("user")
    return scratch.save(dense_ids(names, "user", "user_id", scratch, "ranges"), "numbers")
