"""User payment network: payments between the owners of addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kithwatch.functions.expressions import Moment, high_end, is_usable, low_end
from kithwatch.graph import Graph
from kithwatch.operators.address_network import eligible
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup, stored_if_large


class MissingAddressError(KeyError):
    """A payment names an address that has no user."""


def payments_of(transactions: DataFrame) -> DataFrame:
    """``(sender, receiver, value, count)`` of nested transactions.

    The first input of a transaction sends all its outputs. Payments of the same two
    addresses are added up at once, so an address that takes part in very many of them is
    small before anything is joined. A transaction without outputs still gives its sender,
    with a null receiver.
    """
    return _totals(
        transactions.select(
            F.try_element_at("inputs.address", F.lit(1)).alias("sender"),
            F.explode_outer("outputs").alias("output"),
        ).select(
            "sender",
            F.col("output.address").alias("receiver"),
            F.col("output.value").alias("value"),
            F.lit(1).alias("count"),
        ),
        "sender",
    )


def payments_of_rows(
    inputs: DataFrame, outputs: DataFrame, order: Sequence[str], transaction: str = "tx"
) -> DataFrame:
    """The same table when every input and output is a row of its own.

    A column ``count`` of the outputs says how many payments a row stands for.
    """
    number = F.col("count") if "count" in outputs.columns else F.lit(1)
    first = inputs.groupBy(transaction).agg(F.min_by("address", F.struct(*order)).alias("sender"))
    received = _totals(
        outputs.select(transaction, F.col("address").alias("receiver"), "value", number.alias("count")),
        transaction,
    )
    sent = lookup(received, first, transaction, ["receiver"]).drop(transaction)
    silent = first.join(outputs.select(transaction).distinct(), transaction, "left_anti").select("sender")
    return _totals(sent.unionByName(silent, allowMissingColumns=True), "sender")


def _totals(payments: DataFrame, by: str) -> DataFrame:
    return payments.groupBy(by, "receiver").agg(F.sum("value").alias("value"), F.sum("count").alias("count"))


def with_users(payments: DataFrame, address_user: DataFrame, on_missing: str = "error") -> DataFrame:
    """``(from_user, to_user, value, count)``, ``to_user`` being null where nobody received.

    ``on_missing`` says what becomes of an address without user: ``"error"`` raises,
    ``"drop"`` leaves the payment out. The result is stored, and is looked up once: what has no
    user is seen when it is written.
    """
    if on_missing not in ("error", "drop"):
        raise ValueError(f"on_missing must be 'error' or 'drop', not {on_missing!r}")
    scratch = Scratch(payments.sparkSession, "payments")
    counted = Observation()
    usable = payments.where(is_usable("sender")).withColumn("receiver", F.expr("nullif(receiver, '')"))
    sent = scratch.save(usable.observe(counted, F.count(F.lit(1)).alias("rows")), "sent")
    rows = counted.get["rows"]
    senders = address_user.select(F.col("address").alias("sender"), F.col("user_id").alias("from_user"))
    receivers = address_user.select(F.col("address").alias("receiver"), F.col("user_id").alias("to_user"))
    known = lookup(sent, senders, "sender", ["receiver"], how="left", rows=rows)
    known = stored_if_large(known, rows, scratch, "known")
    # Payments to nobody are kept apart: their null would be one hot key.
    reached = lookup(known.where(F.col("receiver").isNotNull()), receivers, "receiver", ["sender"], how="left", rows=rows)
    placed = reached.unionByName(known.where(F.col("receiver").isNull()), allowMissingColumns=True)
    unplaced = F.col("from_user").isNull() | (F.col("receiver").isNotNull() & F.col("to_user").isNull())
    if on_missing == "drop":
        placed = placed.where(~unplaced)
    seen = Observation()
    stored = scratch.save(placed.observe(seen, F.count_if(unplaced).alias("missing")), "placed")
    if seen.get["missing"]:
        found = stored.where(unplaced).select(F.when(F.col("from_user").isNull(), F.col("sender")).otherwise(F.col("receiver"))).first()
        scratch.drop()
        raise MissingAddressError(f"no user for address {found[0]!r}")
    scratch.drop("sent")
    scratch.drop("known")
    return stored.select("from_user", "to_user", "value", "count")


def missing_addresses(payments: DataFrame, address_user: DataFrame) -> DataFrame:
    """Usable addresses of the payments that the map does not hold."""
    named = (
        payments.where(is_usable("sender"))
        .select(F.explode(F.array("sender", "receiver")).alias("address"))
        .where(is_usable("address"))
        .distinct()
    )
    return named.join(address_user, "address", "left_anti")


def between_users(user_payments: DataFrame) -> DataFrame:
    """Payments that reach another user; change is left out."""
    return user_payments.where(F.col("from_user") != F.col("to_user"))


def payment_edges(user_payments: DataFrame) -> DataFrame:
    """Sum and number of the payments of each pair of users, both ways together."""
    return (
        between_users(user_payments)
        .groupBy(low_end("from_user", "to_user").alias("src"), high_end("from_user", "to_user").alias("dst"))
        .agg(F.sum("value").alias("value"), F.sum("count").alias("count"))
    )


def payment_nodes(user_payments: DataFrame) -> DataFrame:
    """Every sender, and every receiver of a payment from someone else."""
    senders = user_payments.select(F.col("from_user").alias("id"))
    receivers = between_users(user_payments).select(F.col("to_user").alias("id"))
    return senders.unionByName(receivers).distinct()


def fold_payment_edges(*parts: DataFrame) -> DataFrame:
    """Merge payment edges of several loads; both measures add up."""
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy("src", "dst").agg(F.sum("value").alias("value"), F.sum("count").alias("count"))


def fold_payment_networks(*parts: Graph) -> Graph:
    nodes = parts[0].nodes
    for more in parts[1:]:
        nodes = nodes.unionByName(more.nodes)
    return Graph(nodes.distinct(), fold_payment_edges(*(part.edges for part in parts)))


def user_network(
    transactions: DataFrame,
    address_user: DataFrame,
    start: Moment = None,
    end: Moment = None,
    on_missing: str = "error",
) -> Graph:
    """Payment graph of nested transactions; a time equal to a bound is dropped."""
    placed = with_users(payments_of(eligible(transactions, start, end, closed="neither")), address_user, on_missing)
    return Graph(payment_nodes(placed), payment_edges(placed))
