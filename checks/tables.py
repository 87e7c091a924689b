"""The given tables seen as transactions, graphs and attributed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithwatch.functions.expressions import in_window
from kithwatch.graph import Graph
from kithwatch.operators.address_network import (
    address_edges,
    address_nodes,
    co_input_pairs_of_rows,
    eligible,
)
from kithwatch.operators.payment_network import payments_of_rows
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup

# The lines of an order in the order they were spent or paid.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx"),
        F.col("o_orderdate").alias("time"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("confirmations"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_coinbase"),
    )


#: A window strictly inside the orders, both ends being days with orders.
INNER_WINDOW = ("1996-03-01T00:00:00+0000", "1999-10-01T00:00:00+0000")


def orders_as_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction for each order with lines: what was kept is spent, what was returned is paid."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("tx"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        *LINE_ORDER,
                        F.concat_ws("-", "l_partkey", "l_suppkey").alias("address"),
                        cents.alias("value"),
                        (F.col("l_returnflag") == "R").alias("is_output"),
                    )
                )
            ).alias("lines")
        )
    )
    chosen = lambda output: F.filter("lines", lambda line: line["is_output"] == output)
    return (
        orders_as_transactions(spark, sf_dir)
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_orderpriority").alias("priority")), "tx")
        .join(lines, "tx")
        .select(
            "time",
            F.col("confirmations").cast("long").alias("confirmations"),
            "is_coinbase",
            "priority",
            F.transform(chosen(False), lambda line: F.struct(line["address"].alias("address"))).alias("inputs"),
            F.transform(chosen(True), lambda line: F.struct(line["address"].alias("address"), line["value"].alias("value"))).alias("outputs"),
        )
    )


def whole_window(spark: SparkSession, sf_dir: str):
    """First and last time of the orders, as bounds of a window."""
    times = orders_as_transactions(spark, sf_dir)
    return times.select(F.min("time")).scalar(), times.select(F.max("time")).scalar()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is an input of its order, or an output if it was returned; copies are counted."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("tx"), *LINE_ORDER, (F.col("l_returnflag") == "R").alias("is_output"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the eligible transactions of the whole time, its ends included, with their time.

    Written, so that queries that need them more than once do not group and look up all lines each time.
    """
    chosen = eligible(orders_as_transactions(spark, sf_dir), *whole_window(spark, sf_dir), "both")
    # Copies of a line follow each other and would only link an address to itself.
    lines = lookup(_lines(spark, sf_dir), chosen.select("tx", "time"), "tx", LINE_ORDER, rows=_size(spark, sf_dir))
    return Scratch(spark, "lines").save(lines.select("tx", "time", *LINE_ORDER, "is_output", "count"), "lines")


def inputs_and_outputs(
    spark: SparkSession, sf_dir: str, closed: str, kept=None, lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Input and output rows of the eligible transactions of the whole time.

    ``lines`` are :func:`order_lines`, where the caller has them; ``kept`` chooses by their time.
    """
    if lines is None:
        lines = order_lines(spark, sf_dir)
    if closed != "both":
        lines = lines.where(in_window("time", *whole_window(spark, sf_dir), closed))
    if kept is not None:
        lines = lines.where(kept)
    lines = lines.withColumn("address", F.concat_ws("-", "l_partkey", "l_suppkey"))
    lines = lines.withColumn("value", F.col("l_extendedprice").cast("decimal(18,2)") * F.col("count"))
    inputs = lines.where(~F.col("is_output")).select("tx", *LINE_ORDER, "address")
    return inputs, lines.where("is_output").select("tx", "address", "value", "count")


def _size(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()


def address_graph(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> Graph:
    inputs, outputs = inputs_and_outputs(spark, sf_dir, "both", lines=lines)
    return Graph(
        address_nodes(inputs.select("address"), outputs.select("address")),
        Scratch(spark, "address-edges").save(address_edges(co_input_pairs_of_rows(inputs, LINE_ORDER)), "edges"),
    )


def order_payments(spark: SparkSession, sf_dir: str, kept=None, lines: DataFrame | None = None) -> DataFrame:
    return payments_of_rows(*inputs_and_outputs(spark, sf_dir, "neither", kept, lines), LINE_ORDER)


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that follow each other in a confirmed order, with size and price."""
    confirmed = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("tx"), *LINE_ORDER, F.col("l_partkey").cast("string").alias("address"))
        .distinct()
    )
    orders = confirmed.select(F.col("o_orderkey").alias("tx"))
    lines = lookup(lines, orders, "tx", LINE_ORDER, rows=_size(spark, sf_dir))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size", "p_retailprice")
    edges = address_edges(co_input_pairs_of_rows(lines, LINE_ORDER))
    return Graph(nodes, Scratch(spark, "part-edges").save(edges, "edges"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given partition of the parts: the number of their brand."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("node"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("community"),
    )


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node"), F.col("label").cast("long").alias("community")
    )


def geography(spark: SparkSession, sf_dir: str, segments: bool = False) -> Graph:
    """Regions, their nations and the suppliers there; market segments close circles."""
    links = (
        table(spark, sf_dir, "nation")
        .select(
            F.concat(F.lit("n"), "n_nationkey").alias("one"), F.concat(F.lit("r"), "n_regionkey").alias("two")
        )
        .unionByName(
            table(spark, sf_dir, "supplier").select(
                F.concat(F.lit("n"), "s_nationkey").alias("one"), F.concat(F.lit("s"), "s_suppkey").alias("two")
            )
        )
    )
    if segments:
        links = links.unionByName(
            table(spark, sf_dir, "customer").select(
                F.concat(F.lit("n"), "c_nationkey").alias("one"), F.concat(F.lit("m"), "c_mktsegment").alias("two")
            )
        )
    edges = links.select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(nodes, edges)


def purchases_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per line: the customer pays the supplier and gets change.

    The second input is the order's own address, left empty where the line status is open.
    """
    line = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    customer = F.concat(F.lit("c"), "o_custkey")
    order = F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("o"), "o_orderkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
    transaction = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssZ").alias("time"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("confirmations"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_coinbase"),
        F.array(F.struct(customer.alias("address")), F.struct(order.alias("address"))).alias("inputs"),
        F.array(
            F.struct(F.concat(F.lit("s"), "l_suppkey").alias("address"), cents.alias("value")),
            F.struct(customer.alias("address"), F.lit(0).cast("decimal(38,0)").alias("value")),
        ).alias("outputs"),
    )
    return line.select(F.array(transaction).alias("data"))


def trade_regions(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations linked within their region and to the one of equal rank in the next; suppliers hang on them.

    A region is held to the next by five links, so that many have to go before anything splits.
    """
    rank = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.row_number().over(rank).alias("place"))
    name = F.concat(F.lit("n"), F.lpad("n_nationkey", 2, "0"))
    one = nations.select(name.alias("one"), "n_regionkey", "place")
    other = nations.select(name.alias("two"), F.col("n_regionkey").alias("region"), F.col("place").alias("rank"))
    inside = one.join(other, (F.col("n_regionkey") == F.col("region")) & (F.col("place") < F.col("rank")))
    across = one.join(other, (F.col("n_regionkey") + 1 == F.col("region")) & (F.col("place") == F.col("rank")))
    hanging = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), F.lpad("s_nationkey", 2, "0")).alias("one"), F.concat(F.lit("s"), "s_suppkey").alias("two")
    )
    links = inside.select("one", "two").unionByName(across.select("one", "two")).unionByName(hanging)
    edges = links.select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst")).distinct()
    return Graph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)
