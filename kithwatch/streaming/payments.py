"""Networks that grow with the block files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kithwatch.functions.expressions import Moment
from kithwatch.graph import Graph
from kithwatch.operators.payment_network import fold_payment_edges, user_network
from kithwatch.operators.scratch import Scratch
from kithwatch.plans.growing import FOLD_EVERY, GrowingNetwork
from kithwatch.sources.generations import Generations


def payment_stream(
    transactions: DataFrame,
    address_user: DataFrame,
    output: str,
    checkpoint: str,
    start: Moment = None,
    end: Moment = None,
    on_missing: str = "error",
    fold_every: int = FOLD_EVERY,
    **trigger,
) -> StreamingQuery:
    """Store the payment network of every batch of a transaction stream, for a given address map.

    Sums and counts add up, so a batch only writes its own part, however large the network
    is; ``fold_every`` of them become one. A batch that is run again after a failure is added once.
    """
    users = dict(address_user.dtypes)["user_id"]
    schemas = {"nodes": f"id {users}", "edges": f"src {users}, dst {users}, value decimal(38,0), count bigint"}

    def store(batch: DataFrame, number: int) -> None:
        stored = Generations(batch.sparkSession, output, schemas)
        now = stored.manifest()
        if number > now.last:
            with Scratch(batch.sparkSession, "batch"):
                part = user_network(batch, address_user, start, end, on_missing)
                now = stored.append(number, {"nodes": part.nodes, "edges": part.edges})
        if len(now.parts) >= fold_every:
            whole = _network(stored)
            stored.fold({"nodes": whole.nodes, "edges": whole.edges})

    writer = transactions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _network(stored: Generations) -> Graph:
    now = stored.manifest()
    return Graph(stored.read("nodes", now).distinct(), fold_payment_edges(stored.read("edges", now)))


def streamed_network(spark: SparkSession, output: str) -> Graph:
    """The network of all batches so far."""
    return _network(Generations(spark, output))


def network_stream(
    transactions: DataFrame,
    output: str,
    checkpoint: str,
    start: Moment = None,
    end: Moment = None,
    fold_every: int = FOLD_EVERY,
    **trigger,
) -> StreamingQuery:
    """Grow address network, users and payments with every batch; :func:`grown_network` reads them.

    New addresses become users, and users that a batch links become one.
    """

    def store(batch: DataFrame, number: int) -> None:
        GrowingNetwork(batch.sparkSession, output, start, end, fold_every).add(batch, number)

    writer = transactions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def grown_network(spark: SparkSession, output: str):
    """Addresses, numbered users and payments of all batches so far."""
    return GrowingNetwork(spark, output).network()


__all__ = ["grown_network", "network_stream", "payment_stream", "streamed_network"]
