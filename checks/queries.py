"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as t
from kithwatch.functions.expressions import is_usable
from kithwatch.graph import Graph
from kithwatch.operators import detectors, glance
from kithwatch.operators.components import address_users, connected_components
from kithwatch.operators.features import feature_table, keep_features, top_features, with_community
from kithwatch.operators.girvan_newman import edge_betweenness, girvan_newman_communities
from kithwatch.operators.laplacian import laplacian_scores, laplacian_scores_with, rank_features
from kithwatch.operators.louvain import louvain_communities
from kithwatch.operators.metrics import METRICS, community_vectors, with_metrics
from kithwatch.operators.modularity import modularity
from kithwatch.operators.neighbors import nearest_affinity
from kithwatch.operators.payment_network import (
    fold_payment_edges,
    missing_addresses,
    payment_edges,
    payment_nodes,
    with_users,
)
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.spectral import spec_scores
from kithwatch.plans.detection import detect_anomalies
from kithwatch.plans.growing import GrowingNetwork
from kithwatch.plans.users import store_user_network, users_of
from kithwatch.sources import store
from kithwatch.sources.blocks import read_transactions, stream_transactions
from kithwatch.sources.graphml import read_graphml
from kithwatch.streaming.payments import payment_stream, streamed_network


def _rounded(result: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        result = result.withColumn(column, F.round(F.col(column).cast("double"), 6))
    return result


# Addresses and users


def co_input_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.address_graph(spark, sf_dir).edges


def address_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.address_graph(spark, sf_dir).nodes


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.address_graph(spark, sf_dir)
    return connected_components(graph.nodes, graph.edges)


def address_user_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users_of(t.address_graph(spark, sf_dir))


def _user_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lines make both the address network and the payments.
    lines = t.order_lines(spark, sf_dir)
    return with_users(t.order_payments(spark, sf_dir, lines=lines), _users(spark, sf_dir, lines))


def _users(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    # Written, as senders and receivers are both looked up in it.
    return Scratch(spark, "users").save(users_of(t.address_graph(spark, sf_dir, lines)), "users")


def payments_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(payment_edges(_user_payments(spark, sf_dir)), "value")


def paying_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_nodes(_user_payments(spark, sf_dir))


def payment_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, split by a date, folded into one network."""
    lines = t.order_lines(spark, sf_dir)
    users = _users(spark, sf_dir, lines)
    early = F.col("time") < F.lit("1998-01-01").cast("timestamp")
    loads = [
        payment_edges(with_users(t.order_payments(spark, sf_dir, part, lines), users)) for part in (early, ~early)
    ]
    return _rounded(fold_payment_edges(*loads), "value")


def unknown_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid addresses that never spend, against a map of the spending ones."""
    lines = t.order_lines(spark, sf_dir)
    graph = t.address_graph(spark, sf_dir, lines)
    spending = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    users = address_users(connected_components(spending, graph.edges))
    return missing_addresses(t.order_payments(spark, sf_dir, lines=lines), users)


# Blocks of transactions


def _block_folder(spark: SparkSession, sf_dir: str) -> str:
    """The blocks as files; their field names repeat in every line, so compressed ones are far smaller."""
    folder = f"{Scratch(spark, 'block-files').base}/blocks"
    t.purchases_as_blocks(spark, sf_dir).write.json(folder, compression="gzip")
    return folder


def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_transactions(spark, _block_folder(spark, sf_dir), one_per_line=True)
    return (
        read.groupBy("time", "confirmations", "is_coinbase")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(F.size(F.filter("inputs.address", is_usable))).alias("usable_inputs"),
            F.sum(F.element_at("outputs.value", 1)).cast("double").alias("paid"),
        )
        .withColumn("time", F.date_format("time", "yyyy-MM-dd"))
    )


def stored_user_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files to address network, users and payments, all of it stored."""
    blocks = _block_folder(spark, sf_dir)
    output = f"{Scratch(spark, 'user-network').base}/networks"
    network = store_user_network(spark, blocks, output, 1995, one_per_line=True)
    return network.users.edges.withColumn("value", F.col("value").cast("double"))


def streamed_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments of the same block files, read as a stream in several batches."""
    blocks = _block_folder(spark, sf_dir)
    scratch = Scratch(spark, "streamed")
    users = (
        read_transactions(spark, blocks, one_per_line=True)
        .select(F.explode(F.concat("inputs.address", "outputs.address")).alias("address"))
        .where(is_usable("address"))
        .distinct()
        .select("address", F.col("address").alias("user_id"))
    )
    users = scratch.save(users, "users")
    stream = stream_transactions(spark, blocks, one_per_line=True, files_per_batch=4)
    output = f"{scratch.base}/network"
    payment_stream(stream, users, output, f"{scratch.base}/progress").awaitTermination()
    return streamed_network(spark, output).edges.withColumn("value", F.col("value").cast("double"))


def address_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, added in loads by their month, users becoming one on the way.

    The window lies inside the data, so that its ends differ between both networks.
    """
    scratch = Scratch(spark, "address-fold")
    orders = scratch.save(t.orders_as_nested(spark, sf_dir), "orders")
    grown = GrowingNetwork(spark, f"{scratch.base}/network", *t.INNER_WINDOW, fold_every=2)
    for number, load in enumerate((1, 0)):
        grown.add(orders.where(F.month("time") % 2 == load), number)
    return grown.network().users.edges.withColumn("value", F.col("value").cast("double"))


def grown_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address map of the same orders, added by priority."""
    scratch = Scratch(spark, "grown-users")
    orders = scratch.save(t.orders_as_nested(spark, sf_dir), "orders")
    grown = GrowingNetwork(spark, f"{scratch.base}/network", *t.INNER_WINDOW)
    first = F.col("priority") < "3"
    for number, load in enumerate((~first, first)):
        grown.add(orders.where(load), number)
    return grown.network().address_user


# Stored graphs and results


def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as GraphML elements and read back."""
    folder = f"{Scratch(spark, 'graphml').base}/parts"
    declared = {"p_size": "int", "p_retailprice": "double", "p_name": "string"}
    keys = spark.createDataFrame(
        [(name, name, kind, "node") for name, kind in declared.items()],
        "_id string, `_attr.name` string, `_attr.type` string, _for string",
    )
    data = [F.struct(F.col(name).cast("string").alias("_VALUE"), F.lit(name).alias("_key")) for name in declared]
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), F.array(*data).alias("data"))
    for tag, rows in (("key", keys), ("node", parts)):
        rows.write.format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{folder}/{tag}")
    return _rounded(read_graphml(spark, f"{folder}/*").nodes, "p_retailprice")


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'stored').base}/graph"
    store.save_graph(t.part_graph(spark, sf_dir), path)
    return store.load_graph(spark, path).edges


def cached_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored at the first call, read at the second."""
    path = f"{Scratch(spark, 'cache').base}/communities"
    store.cached_communities(spark, path, "given", lambda: t.brands(spark, sf_dir))

    def again() -> DataFrame:
        raise AssertionError("the stored communities were not used")

    return store.cached_communities(spark, path, "given", again)


def stored_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite and finite scores through the JSON sink."""
    path = f"{Scratch(spark, 'results').base}/scores"
    store.save_anomalies_json(pseudo_cada(spark, sf_dir), path)
    return spark.read.schema("node string, score double").json(path)


# Metrics and detectors on the part graph


def neighbor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.part_graph(spark, sf_dir)
    wanted = [m for m in METRICS if m != "neighborsCommunityVector"]
    return with_metrics(graph.nodes.select("id"), graph.edges, t.brands(spark, sf_dir), wanted)


def neighbor_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = community_vectors(t.part_graph(spark, sf_dir).edges, t.brands(spark, sf_dir))
    return vectors.select("node", F.explode("vector").alias("community", "count"))


def degree_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.part_graph(spark, sf_dir)
    return detectors.degree_anomalies(graph.nodes, graph.edges)


def within_community_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.part_graph(spark, sf_dir).edges
    return detectors.within_community_anomalies(edges, t.brands(spark, sf_dir), threshold=2.0)


def cada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detectors.cada_scores(t.part_graph(spark, sf_dir).edges, t.brands(spark, sf_dir)), "score")


def pseudo_cada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detectors.pseudo_cada_scores(t.part_graph(spark, sf_dir).edges, t.brands(spark, sf_dir)), "score")


def modularity_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(modularity(t.part_graph(spark, sf_dir).edges, t.brands(spark, sf_dir)), "modularity")


def glance_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and fractional attributes, with many equal values."""
    nodes = t.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), "p_size", "p_retailprice"
    )
    return _rounded(detectors.glance(nodes, t.brands(spark, sf_dir)), "score")


# Communities


def louvain_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any good partition of the address network must satisfy, whatever it is."""
    graph = t.address_graph(spark, sf_dir)
    scratch = Scratch(spark, "louvain-check")
    nodes = scratch.save(graph.nodes, "nodes")
    found = scratch.save(louvain_communities(nodes, graph.edges), "found")
    reached = modularity(graph.edges, found).select("modularity").scalar()
    start = found.select(F.col("node").alias("src"), F.col("community").alias("from"))
    end = found.select(F.col("node").alias("dst"), F.col("community").alias("to"))
    inside = graph.edges.join(start, "src").join(end, "dst").where(F.col("from") == F.col("to"))
    joined = connected_components(nodes, inside.select("src", "dst"))
    parts = joined.select("component").distinct().select(F.count(F.lit(1))).scalar()
    return found.agg(
        F.count(F.lit(1)).alias("nodes"),
        (F.count_distinct("node") == F.count(F.lit(1))).alias("one_each"),
        (F.count_distinct("community") == parts).alias("connected"),
    ).withColumn("modular", reached > 0.9)


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.geography(spark, sf_dir, segments=True)
    return _rounded(edge_betweenness(graph.nodes, graph.edges), "betweenness")


def girvan_newman_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.geography(spark, sf_dir)
    return girvan_newman_communities(graph.nodes, graph.edges)


def girvan_newman_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that splits after five removals."""
    graph = t.trade_regions(spark, sf_dir)
    return girvan_newman_communities(graph.nodes, graph.edges)


# Features of the embeddings, labels being the communities


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(with_community(t.embedding_nodes(spark, sf_dir), t.embedding_labels(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = t.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("class"), F.lit("x").alias("text")
    )
    return _rounded(feature_table(wide).select("node", "attr", "idx", "value"), "value")


def average_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(glance.mean_differences(_labelled(spark, sf_dir)).drop("n"), "mean_difference")


def glance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(glance.glance_scores(_labelled(spark, sf_dir)), "score")


def glance_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detectors.above(glance.glance_scores(_labelled(spark, sf_dir)), 0.95), "score")


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(laplacian_scores(_labelled(spark, sf_dir)), "score")


def laplacian_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tenth of the features."""
    ranked = rank_features(laplacian_scores(_labelled(spark, sf_dir)))
    return keep_features(ranked, top_features(ranked, 0.1)).select("attr", "idx", "rank")


def laplacian_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given affinity: parts that follow each other, weighed by how often they do."""
    graph = t.part_graph(spark, sf_dir)
    weight = 1.0 / (1 + F.abs(F.col("src").cast("long") - F.col("dst").cast("long")))
    one_way = graph.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), weight.alias("weight"))
    affinity = one_way.unionByName(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    return _rounded(laplacian_scores_with(feature_table(graph.nodes), affinity), "score")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_affinity(t.embedding_nodes(spark, sf_dir))


def laplacian_of_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.embedding_nodes(spark, sf_dir)
    return _rounded(laplacian_scores_with(feature_table(nodes), nearest_affinity(nodes)), "score")


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spec_scores(t.embedding_nodes(spark, sf_dir)), "score")


def run_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run on given communities: select features, then score with them."""
    nodes = t.embedding_nodes(spark, sf_dir)
    edges = spark.createDataFrame([], "src bigint, dst bigint")
    found = detect_anomalies(
        Graph(nodes, edges),
        anomaly_method="glance",
        feature_selection="laplacian",
        communities=t.embedding_labels(spark, sf_dir),
    )
    return _rounded(found.anomalies, "score")


# Where ties, large numbers, distances and links decide


def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked to their nations, in both directions and without node elements."""
    folder = f"{Scratch(spark, 'graphml').base}/customers"
    person = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    data = lambda value: F.array(F.struct(F.lit("w").alias("_key"), value.cast("string").alias("_VALUE"))).alias("data")
    customers = t.table(spark, sf_dir, "customer")
    there = customers.select(person.alias("_source"), nation.alias("_target"), data(F.col("c_acctbal")))
    back = customers.select(nation.alias("_source"), person.alias("_target"), data(F.col("c_acctbal") + 1))
    key = spark.createDataFrame([("w", "balance", "double", "edge")], "_id string, `_attr.name` string, `_attr.type` string, _for string")
    for tag, table in (("key", key), ("edge", there.union(back))):
        table.write.format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{folder}/{tag}")
    graph = read_graphml(spark, f"{folder}/*")
    sizes = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    joined = graph.nodes.join(sizes, "id").join(graph.edges, F.col("id") == F.col("src"), "left")
    return _rounded(joined.select("id", "degree", "dst", "balance"), "balance")


def louvain_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers linked to the first of their nation: one community for each nation, no other."""
    suppliers = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    first = suppliers.groupBy("s_nationkey").agg(F.min("id").alias("src"))
    edges = suppliers.join(first, "s_nationkey").where("id != src").select("src", F.col("id").alias("dst"))
    return louvain_communities(suppliers.select("id"), edges)


def nearest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation have equal directions, so the smallest ids win."""
    vector = F.array((F.col("s_nationkey") + 1).cast("double") * (F.col("s_suppkey") + 1), (F.col("s_suppkey") + 1).cast("double"))
    return nearest_affinity(t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), vector.alias("v")))


def spec_scores_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts so far apart that most similarities are next to 0."""
    nodes = t.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("price"), (F.col("p_size") * 3.0).alias("size")
    )
    return _rounded(spec_scores(nodes), "score")


def glance_large_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of nineteen digits."""
    large = (F.col("p_size").cast("long") + 100) * F.lit(1 << 53)
    nodes = t.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), large.alias("large"))
    labelled = feature_table(with_community(nodes, t.brands(spark, sf_dir)))
    return _rounded(glance.glance_scores(labelled), "score")


def glance_next_to_2_53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers that doubles would merge: 2^53 and what the size of a part adds to it."""
    large = F.lit(1 << 53) + F.col("p_size").cast("long")
    nodes = t.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), large.alias("large"))
    return _rounded(detectors.glance(nodes, t.brands(spark, sf_dir)), "score")


QUERIES = {
    "co_input_edges": co_input_edges,
    "address_nodes": address_nodes,
    "connected_components": components,
    "address_user_map": address_user_map,
    "payment_edges": payments_by_pair,
    "payment_nodes": paying_users,
    "payment_fold": payment_fold,
    "missing_addresses": unknown_addresses,
    "block_scan": block_scan,
    "stored_user_network": stored_user_network,
    "streamed_payments": streamed_payments,
    "address_fold": address_fold,
    "grown_users": grown_users,
    "graphml_nodes": graphml_nodes,
    "stored_graph": stored_graph,
    "cached_communities": cached_communities,
    "stored_anomalies": stored_anomalies,
    "neighbor_metrics": neighbor_metrics,
    "neighbor_vector": neighbor_vector,
    "degree_anomalies": degree_anomalies,
    "within_community_anomalies": within_community_anomalies,
    "cada": cada,
    "pseudo_cada": pseudo_cada,
    "modularity": modularity_of_brands,
    "glance_of_parts": glance_of_parts,
    "louvain_invariants": louvain_invariants,
    "edge_betweenness": betweenness,
    "girvan_newman_split": girvan_newman_split,
    "girvan_newman_removals": girvan_newman_removals,
    "feature_table": features,
    "avg_difference": average_differences,
    "glance_scores": glance_scores,
    "glance_anomalies": glance_anomalies,
    "laplacian_scores": laplacian,
    "laplacian_top": laplacian_top,
    "laplacian_affinity": laplacian_by_price,
    "nearest_affinity": nearest,
    "laplacian_nearest": laplacian_of_nearest,
    "spec_scores": spec,
    "run_glance": run_glance,
    "graphml_edges": graphml_edges,
    "louvain_stars": louvain_stars,
    "nearest_ties": nearest_ties,
    "spec_scores_sparse": spec_scores_sparse,
    "glance_large_whole": glance_large_whole,
    "glance_next_to_2_53": glance_next_to_2_53,
}
