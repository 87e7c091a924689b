"""Co-input address network: addresses spent together belong together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.functions.expressions import Moment, in_window, is_coinbase, is_confirmed, is_usable
from kithwatch.graph import Graph, canonical_pairs
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import next_value


def eligible(transactions: DataFrame, start: Moment = None, end: Moment = None, closed: str = "both") -> DataFrame:
    """Confirmed, non-coinbase transactions of a time window."""
    return transactions.where(in_window("time", start, end, closed) & is_confirmed() & ~is_coinbase())


def co_input_pairs(transactions: DataFrame) -> DataFrame:
    """Each input address with the next one of the same transaction.

    Works on the nested input list of a row, so nothing is shuffled.
    """
    inputs = F.col("inputs.address")
    links = F.greatest(F.size(inputs) - 1, F.lit(0))
    return (
        transactions.select(
            F.explode(
                F.zip_with(
                    F.slice(inputs, F.lit(1), links),
                    F.slice(inputs, F.lit(2), links),
                    lambda a, b: F.struct(a.alias("address"), b.alias("next_address")),
                )
            ).alias("link")
        )
        .select("link.*")
        .where(is_usable("address") & is_usable("next_address"))
    )


def co_input_stars(transactions: DataFrame) -> DataFrame:
    """``(src, dst)`` links between the same addresses as :func:`co_input_pairs`, in fewer steps from each other.

    Inputs are linked to the smallest of their transaction. Where some are unusable, these part the
    others, which are linked one by one.
    """
    inputs = F.col("inputs.address")
    parted = F.exists(inputs, lambda address: ~is_usable(address))
    whole = transactions.where(~parted).select(F.array_min(inputs).alias("src"), inputs.alias("all"))
    stars = whole.select("src", F.explode("all").alias("dst")).where(F.col("src") != F.col("dst"))
    return stars.unionByName(co_input_pairs(transactions.where(parted)).toDF("src", "dst"))


def co_input_pairs_of_rows(inputs: DataFrame, order: Sequence[str], transaction: str = "tx") -> DataFrame:
    """The same pairs when every input is a row of its own, listed by ``order``."""
    scratch = Scratch(inputs.sparkSession, "co-input")
    listed = scratch.save(inputs.select(transaction, *order, "address"), "inputs")
    followed = next_value(listed, [transaction], list(order), "address", "next_address", scratch, "chunks")
    return followed.select("address", "next_address").where(is_usable("address") & is_usable("next_address"))


def address_edges(pairs: DataFrame) -> DataFrame:
    return canonical_pairs(pairs, "address", "next_address")


def address_nodes(*address_columns: DataFrame) -> DataFrame:
    """Every usable address of the given one-column tables, as node table."""
    merged = address_columns[0].toDF("id")
    for more in address_columns[1:]:
        merged = merged.unionByName(more.toDF("id"))
    return merged.where(is_usable("id")).distinct()


def address_network(transactions: DataFrame, start: Moment = None, end: Moment = None) -> Graph:
    """Address graph of nested transactions; a time equal to a bound is kept."""
    kept = eligible(transactions, start, end, closed="both")
    nodes = address_nodes(
        kept.select(F.explode("inputs.address")),
        kept.select(F.explode("outputs.address")),
    )
    return Graph(nodes, address_edges(co_input_pairs(kept)))
