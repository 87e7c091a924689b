"""What must not depend on block sizes, rounds, ranges or half-read input."""

import json
import os
import subprocess
import sys
from pathlib import Path

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch.operators import neighbors, row_blocks, skew
from kithwatch.operators.features import feature_table
from kithwatch.operators.glance import far_shares, mean_differences
from kithwatch.operators.louvain import louvain_communities
from kithwatch.operators.neighbors import nearest_affinity
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.spectral import spec_scores
from kithwatch.sources import store
from kithwatch.sources.blocks import stream_transactions
from kithwatch.sources.graphml import read_graphml


def nodes_of(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(values)], "id long, v array<double>")


@pytest.mark.parametrize("size", [1, 4, 64])
def test_spec_of_far_values_for_any_block_size(spark, monkeypatch, size):
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", size)
    monkeypatch.setattr(row_blocks, "BLOCK_ROWS", size)
    rng = np.random.default_rng(1)
    values = np.stack([np.arange(24) * 7.0, rng.random(24)], axis=1)
    found = [score for *_, score in rows(spec_scores(nodes_of(spark, values)))]
    assert found == pytest.approx(brute.spec_by_pairs(values), rel=1e-9)


@pytest.mark.parametrize("size", [8, 64])
def test_nearest_with_ties(spark, monkeypatch, size):
    monkeypatch.setattr(row_blocks, "LEAST_BLOCK_ROWS", size)
    monkeypatch.setattr(row_blocks, "BLOCK_ROWS", size)
    rng = np.random.default_rng(2)
    base = rng.random((5, 3))
    values = np.array([base[i % 5] * (1 + i) for i in range(60)])
    unit = values / np.linalg.norm(values, axis=1)[:, None]
    similarity = np.round(unit @ unit.T, neighbors.DIGITS)
    wanted = {(i, i) for i in range(60)}
    for i in range(60):
        for j in sorted((j for j in range(60) if j != i), key=lambda j: (-similarity[i, j], j))[:3]:
            wanted |= {(i, j), (j, i)}
    assert {(i, j) for i, j, _ in rows(nearest_affinity(nodes_of(spark, values), k=3))} == wanted


def test_candidates_of_equal_vectors_stay_few(spark):
    pairs = row_blocks.block_pairs(row_blocks.feature_vectors(nodes_of(spark, np.zeros((200, 2))), None, None)[0], 2, Scratch(spark, "few"))
    import pyarrow as pa

    made = pairs.mapInArrow(neighbors._closest(5, 2, pa.int64()), "i long, j long, similarity double")
    blocks = pairs.where("same").count()
    assert made.count() <= 200 * 5 * blocks


def test_louvain_says_when_it_has_not_settled(spark):
    edges = [(c * 6 + i, c * 6 + j, 1.0) for c in range(5) for i in range(6) for j in range(i)] + [(c * 6, c * 6 + 6, 1.0) for c in range(4)]
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    table = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "src long, dst long, weight double")
    with pytest.raises(RuntimeError, match="not settled"):
        louvain_communities(nodes, table, max_rounds=1).collect()
    groups = dict(rows(louvain_communities(nodes, table)))
    assert len(set(groups.values())) == 5 and all(groups[n] == groups[n // 6 * 6] for n in range(30))


def test_windows_are_really_split(spark):
    spark.conf.set("spark.kithwatch.windowRows", "10")
    try:
        table = spark.range(4000).selectExpr("1 as g", "id * 7919 % 4001 as x", "id % 3 as w")
        scratch = Scratch(spark, "split")
        found = skew.running_total(table, ["g"], ["x"], "w", "upto", "all", scratch, "cut")
        ranges = spark.read.parquet(f"{scratch.base}/cut").groupBy("_chunk").count().collect()
        assert len(ranges) >= 200 and max(row["count"] for row in ranges) <= 40
        total = 0
        for x, w, upto, everything in sorted((row["x"], row["w"], row["upto"], row["all"]) for row in found.collect()):
            total += w
            assert upto == total
        assert everything == total
    finally:
        spark.conf.unset("spark.kithwatch.windowRows")


@pytest.mark.parametrize("shift", [0, 1_700_000_000_000_000_000, -(1 << 62)])
def test_glance_of_large_whole_numbers(spark, shift):
    step = 4096
    values = [1, 2, 2, 5, 9, 40]
    nodes = spark.createDataFrame([(i, 0, shift + step * x) for i, x in enumerate(values)], "id long, community long, x long")
    features = feature_table(nodes)
    mean = sum(abs(a - b) for a in values for b in values) / 36
    assert rows(mean_differences(features), "n", "mean_difference") == [(6, pytest.approx(step * mean))]
    shares = {node: share for node, share in rows(far_shares(features), "node", "share")}
    assert shares == {i: pytest.approx(sum(abs(a - b) > mean for b in values) / 6) for i, a in enumerate(values)}


def test_stream_stops_at_a_malformed_file(spark, tmp_path):
    good = {"data": [{"time": "2012-06-19T04:29:41+0000", "confirmations": 5, "is_coinbase": False, "inputs": [{"address": "A"}], "outputs": []}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(good))
    (tmp_path / "in" / "2.json").write_text(json.dumps(good)[:60])
    query = (
        stream_transactions(spark, str(tmp_path / "in"))
        .writeStream.format("memory")
        .queryName("malformed")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    with pytest.raises(Exception, match="(?i)malformed"):
        query.awaitTermination()


GRAPH = """<graphml><key id="w" for="edge" attr.name="weight" attr.type="double"/>
<key id="c" for="node" attr.name="c" attr.type="int"><default>7</default></key>
<graph edgedefault="{kind}"><node id="a"><data key="c">1</data></node>
<edge source="a" target="b"><data key="w">2.0</data></edge><edge source="b" target="a"><data key="w">1.0</data></edge>
<edge source="b" target="c"/></graph></graphml>"""


def test_graphml_ends_parallels_and_directions(spark, tmp_path):
    for kind in ("undirected", "directed"):
        (tmp_path / f"{kind}.graphml").write_text(GRAPH.format(kind=kind))
    graph = read_graphml(spark, str(tmp_path / "undirected.graphml"))
    assert rows(graph.nodes, "id", "c") == [("a", 1), ("b", 7), ("c", 7)]
    assert sorted(map(tuple, graph.edges.select("src", "dst", "weight").collect()), key=str) == [("a", "b", 1.0), ("b", "c", None)]
    with pytest.raises(ValueError, match="directed"):
        read_graphml(spark, str(tmp_path / "directed.graphml"))
    assert read_graphml(spark, str(tmp_path / "directed.graphml"), directed="ignore").edges.count() == 2


def test_half_written_communities_are_computed_again(spark, tmp_path):
    made = spark.createDataFrame([("a", 1)], "node string, community long")
    path = str(tmp_path / "cache")
    store.store_communities(made, path, "m")
    assert store.cached_communities(spark, path, "m", lambda: pytest.fail("stored")).count() == 1
    os.remove(f"{path}/m/_SUCCESS")
    again = store.cached_communities(spark, path, "m", lambda: made.union(made))
    assert again.count() == 2 and store.cached_communities(spark, path, "m", lambda: pytest.fail("stored")).count() == 2


def test_empty_anomalies_leave_no_folder(spark, tmp_path):
    none = spark.createDataFrame([], "node string, score double")
    with pytest.raises(ValueError, match="no anomalies"):
        store.save_anomalies_json(none, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from kithwatch.shipping import ship
from kithwatch.operators.spectral import spec_scores
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
ship(spark)
nodes = spark.createDataFrame([(i, [float(i), float(i * i % 5)]) for i in range(9)], "id long, v array<double>")
print("scores", spec_scores(nodes).count())
"""


def test_tasks_find_the_package_from_any_folder(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT.format(root=str(Path(__file__).resolve().parent.parent), shared=str(tmp_path / "shared")))
    clean = {name: value for name, value in os.environ.items() if name not in ("PYTHONPATH", "SPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert "scores 2" in ran.stdout, ran.stderr[-2000:]


def test_hot_keys_by_buckets(spark, monkeypatch):
    """Keys share buckets, some of which are crowded without a hot key."""
    monkeypatch.setattr(skew, "BUCKETS", 2)
    spark.conf.set("spark.kithwatch.hotRows", "3")
    try:
        facts = spark.createDataFrame([(k, 1 + k % 2) for k in (1, 1, 1, 1, 2, 2, 3, 4, 5, 5, 5)] + [(None, 9)], "k long, n long")
        assert dict(rows(skew.hot_keys(facts.where("k is not null"), ["k"]))) == {1: 2}
        assert dict(rows(skew.hot_keys(facts.where("k is not null"), ["k"], F.col("n")))) == {1: 3, 5: 2}
        assert [r._pieces for r in skew.hot_keys(facts, ["k"], F.col("n")).where("k is null").collect()] == [3]
    finally:
        spark.conf.unset("spark.kithwatch.hotRows")


def test_lines_of_orders_are_written_once(spark, tmp_path):
    from checks import tables

    orders = [(1, "F", "1-URGENT"), (2, "P", "1-URGENT"), (3, "F", "5-LOW"), (4, "O", "2-HIGH"), (4, "O", "2-HIGH")]
    day = F.to_timestamp(F.lit("1997-01-01"))
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").withColumn(
        "o_orderdate", day
    ).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, 10 + k, 5, n, "R" if n > 1 else "N", 2.5) for k in (1, 2, 3, 4) for n in (1, 2, 2)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spent, paid = tables.inputs_and_outputs(spark, str(tmp_path), "both")
    assert rows(spent, "tx", "address") == [(1, "11-5"), (4, "14-5"), (4, "14-5")]
    assert [(t, a, float(v), n) for t, a, v, n in rows(paid)] == [(1, "11-5", 5.0, 2), (4, "14-5", 5.0, 2), (4, "14-5", 5.0, 2)]
    assert not any("lineitem" in file or "orders" in file for table in (spent, paid) for file in table.inputFiles())


def test_both_loads_of_a_fold_read_the_same_lines(spark, tmp_path, monkeypatch):
    """Orders of the first and the last day link addresses but pay nobody; the lines are worked out once."""
    from checks import queries, tables

    days = {1: "1997-01-01", 2: "1997-06-01", 3: "1998-02-01", 4: "1998-03-01", 5: None}
    spark.createDataFrame(
        [(k, "F", "1-URGENT", day) for k, day in days.items()],
        "o_orderkey long, o_orderstatus string, o_orderpriority string, day string",
    ).withColumn("o_orderdate", F.to_timestamp("day")).write.parquet(str(tmp_path / "orders.parquet"))
    # The sender is the first line, which the second is spent with; the third is returned and so paid.
    lines = [(k, part, 5, n, "R" if n == 3 else "N", 2.5 * k) for k in days for n, part in ((1, 10), (2, 10 + k), (3, 30))]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda scratch, table, name: saved.append(name) or save(scratch, table, name))
    # Users 0 (10-5 and what is spent with it) and 1 (30-5); orders 2 and 3 alone lie inside the time.
    assert rows(queries.payment_fold(spark, str(tmp_path)), "src", "dst", "value", "count") == [(0, 1, 12.5, 2)]
    assert saved.count("lines") == 1
    early = F.col("time") < F.lit("1998-01-01").cast("timestamp")
    shared = tables.order_lines(spark, str(tmp_path))
    for part in (early, ~early, None):
        alone = rows(tables.order_payments(spark, str(tmp_path), part))
        assert alone == rows(tables.order_payments(spark, str(tmp_path), part, shared))
        assert sum(row[3] for row in alone) == (2 if part is None else 1)
