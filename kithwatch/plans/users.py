"""From block files to stored address and user networks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kithwatch.functions.expressions import Moment
from kithwatch.graph import Graph
from kithwatch.operators.address_network import address_network
from kithwatch.operators.components import address_users, connected_components
from kithwatch.operators.payment_network import user_network
from kithwatch.operators.scratch import Scratch
from kithwatch.sources.blocks import load_transactions, read_transactions, save_transactions
from kithwatch.sources.store import load_address_users, load_graph, save_address_users, save_graph, written


@dataclass(frozen=True)
class UserNetwork:
    addresses: Graph
    address_user: DataFrame
    users: Graph


def users_of(addresses: Graph) -> DataFrame:
    """``(address, user_id)``: addresses linked by common spending have one user."""
    return address_users(connected_components(addresses.nodes, addresses.edges))


def window_folder(year: int, start: Moment = None, end: Moment = None) -> str:
    """Folder below the output that holds one year and window."""
    if start is None and end is None:
        return f"year={year}/window=all"
    return f"year={year}/window={_compact(start)}_{_compact(end)}"


def _compact(moment: Moment) -> str:
    text = "open" if moment is None else str(moment)
    return "".join(c if c.isalnum() or c in "+-." else "-" for c in text)


def store_user_network(
    spark: SparkSession,
    blocks: str,
    output: str,
    year: int,
    start: Moment = None,
    end: Moment = None,
    one_per_line: bool = False,
    copy: str | None = None,
) -> UserNetwork:
    """Build and store address network, address map and user network of a block folder.

    The block files are parsed once; both networks read the columnar copy. A transaction at
    a bound of the window is part of the address network but not of the user network.

    ``copy`` names a folder for the copy, which keeps it by day: further windows of the same blocks
    parse nothing again and read their own days only.
    """
    folder = f"{output}/{window_folder(year, start, end)}"
    with Scratch(spark, "blocks") as scratch:
        if copy is None:
            transactions = scratch.save(read_transactions(spark, blocks, one_per_line), "transactions")
        else:
            if not written(spark, copy):
                save_transactions(read_transactions(spark, blocks, one_per_line), copy, mode="overwrite")
            transactions = load_transactions(spark, copy, start, end)
        return _store_networks(spark, transactions, folder, start, end)


def _store_networks(spark: SparkSession, transactions: DataFrame, folder: str, start: Moment, end: Moment) -> UserNetwork:
    save_graph(address_network(transactions, start, end), f"{folder}/addresses", mode="overwrite")
    addresses = load_graph(spark, f"{folder}/addresses")
    save_address_users(users_of(addresses), f"{folder}/address_user", mode="overwrite")
    address_user = load_address_users(spark, f"{folder}/address_user")
    save_graph(user_network(transactions, address_user, start, end), f"{folder}/users", mode="overwrite")
    return UserNetwork(addresses, address_user, load_graph(spark, f"{folder}/users"))
