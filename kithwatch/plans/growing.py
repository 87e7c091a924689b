"""Address and user networks that grow with every load of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwatch.functions.expressions import Moment
from kithwatch.graph import Graph, canonical_pairs
from kithwatch.operators.address_fold import fold_users, numbered_users, resolved
from kithwatch.operators.address_network import address_network, co_input_stars, eligible
from kithwatch.operators.payment_network import payment_edges, payment_nodes, payments_of, with_users
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup
from kithwatch.plans.users import UserNetwork
from kithwatch.sources.generations import Generations, Manifest

SCHEMAS = {
    "nodes": "id string",
    "edges": "src string, dst string",
    "members": "address string, user string",
    "payments": "src string, dst string, value decimal(38,0), count bigint",
    "payers": "id string",
    "changes": "user string, into string",
}
#: Loads after which all there is is folded into one copy.
FOLD_EVERY = 32


class GrowingNetwork:
    """Networks of all transactions added so far, stored in a folder.

    A load writes what it adds: its addresses and links, its new members, its payments between
    users as they are called by then, and the users that have become others. Networks are the
    same in whatever order, and in however many loads, transactions are added.
    """

    def __init__(self, spark: SparkSession, path: str, start: Moment = None, end: Moment = None, fold_every: int = FOLD_EVERY):
        self.spark, self.start, self.end, self.fold_every = spark, start, end, fold_every
        self.stored = Generations(spark, path, SCHEMAS, latest=["changes"])

    def add(self, transactions: DataFrame, number: int) -> Manifest:
        """Add a load; numbers rise, and a number that has been added is left out."""
        now = self.stored.manifest()
        if number > now.last:
            with Scratch(self.spark, "load") as scratch:
                now = self.stored.append(number, self._load(transactions, now, scratch))
        if len(now.parts) >= self.fold_every:
            now = self.stored.fold(self._whole(now))
        return now

    def _load(self, transactions: DataFrame, now: Manifest, scratch: Scratch) -> dict[str, DataFrame]:
        kept = scratch.save(eligible(transactions, self.start, self.end, closed="both"), "transactions")
        network = address_network(kept, self.start, self.end)
        addresses = Graph(scratch.save(network.nodes, "nodes"), scratch.save(network.edges, "edges"))
        users = fold_users(self.stored.read("members", now), self.stored.read("changes", now), addresses, scratch, co_input_stars(kept))
        paid = payments_of(eligible(kept, self.start, self.end, closed="neither"))
        between = with_users(paid, users.placed.withColumnRenamed("user", "user_id"))
        return {
            "nodes": addresses.nodes,
            "edges": addresses.edges,
            "members": users.additions,
            "payments": payment_edges(between),
            "payers": payment_nodes(between),
            "changes": users.changes,
        }

    def _whole(self, now: Manifest) -> dict[str, DataFrame]:
        """All tables in one copy, every user being called as it is now."""
        read = lambda name: self.stored.read(name, now)
        changes = read("changes")
        payments = resolved(resolved(read("payments"), "src", changes, ["dst"]), "dst", changes, ["src"])
        payments = payments.withColumnsRenamed({"src": "from_user", "dst": "to_user"})
        return {
            "nodes": read("nodes").distinct(),
            "edges": canonical_pairs(read("edges"), "src", "dst"),
            "members": resolved(read("members"), "user", changes, ["address"]),
            # Payments between users that have become one are change now.
            "payments": payment_edges(payments),
            "payers": resolved(read("payers"), "id", changes, ["id"]).distinct(),
            "changes": changes.limit(0),
        }

    def network(self) -> UserNetwork:
        """The networks as one run over all transactions gives them, users being numbered."""
        scratch = Scratch(self.spark, "grown")
        whole = self._whole(self.stored.manifest())
        members = scratch.save(whole["members"], "members")
        numbers = numbered_users(members, scratch)
        named = lambda column, into: numbers.select(F.col("user").alias(column), F.col("user_id").alias(into))
        paid = scratch.save(whole["payments"], "payments")
        rows = paid.count()
        ends = lookup(lookup(paid, named("src", "from_user"), "src", ["dst"], rows=rows), named("dst", "to_user"), "dst", ["src"], rows=rows)
        payers = whole["payers"].join(named("id", "user_id"), "id").select(F.col("user_id").alias("id"))
        address_user = lookup(members, numbers, "user", ["address"]).select("address", "user_id")
        return UserNetwork(Graph(whole["nodes"], whole["edges"]), address_user, Graph(payers, payment_edges(ends)))
