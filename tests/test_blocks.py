import json
from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kithwatch.functions.expressions import in_window, transaction_time
from kithwatch.operators.address_network import address_network, co_input_pairs_of_rows
from kithwatch.operators.payment_network import (
    MissingAddressError,
    fold_payment_networks,
    missing_addresses,
    payments_of,
    payments_of_rows,
    user_network,
    with_users,
)
from kithwatch.plans.users import store_user_network, users_of, window_folder
from kithwatch.sources.blocks import load_transactions, read_transactions, stream_transactions, transactions_of
from kithwatch.sources.store import load_address_users, load_graph
from kithwatch.streaming.payments import payment_stream, streamed_network


def tx(inputs, outputs, time="2012-06-19T04:29:41+0000", confirmations=5, coinbase=False):
    return {
        "time": time,
        "confirmations": confirmations,
        "is_coinbase": coinbase,
        "inputs": [{"address": a} for a in inputs],
        "outputs": [{"address": a, "value": v} for a, v in outputs],
    }


EARLY, LATE = "2012-06-01T00:00:00+0000", "2012-07-01T00:00:00+0000"

BLOCKS = [
    [
        tx(["A", "B", "C"], [("D", 100), ("A", 7)]),
        tx(["D"], [("A", 5)]),
        tx(["X", "Y"], [("Z", 1)], confirmations=0),
        tx(["X", "Y"], [("Z", 1)], coinbase=True),
        tx([None, "E", "F"], [("G", 3)]),
        tx(["E", "", "H"], [("G", 4), ("", 9), (None, 9)]),
        tx(["I", "J", None], []),
        tx([], [("K", 2)]),
        tx(["E", "E"], [("E", 1)]),
    ],
    [
        tx(["D"], [("B", 11)]),
        tx(["L", "M"], [("A", 20)], time=EARLY),
        tx(["N", "M"], [("A", 30)], time=LATE),
        tx(["O", "P"], [("A", 40)], time="2012-07-01T00:00:01+0000"),
        tx(["Q"], [("G", 6)], time="2012-07-01T01:30:00+0200"),
    ],
]


@pytest.fixture
def folder(tmp_path):
    for number, block in enumerate(BLOCKS):
        (tmp_path / f"block-{number}.json").write_text(json.dumps({"data": block}))
    return str(tmp_path)


@pytest.fixture
def transactions(spark, folder):
    return read_transactions(spark, folder).cache()


def test_time(spark):
    texts = ["2012-06-19T04:29:41+0000", "2012-06-19T06:29:41+02:00", "2012-06-19T04:29:41Z"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        transaction_time("t").cast("long").alias("s")
    )
    assert rows(found) == [(1340080181,)] * 3
    bad = spark.createDataFrame([("June",)], "t string")
    with pytest.raises(PySparkException):
        bad.select(transaction_time("t")).collect()
    assert rows(bad.select(transaction_time("t", lenient=True))) == [(None,)]


def test_window_ends(spark):
    times = spark.createDataFrame([(EARLY,), ("2012-06-15T00:00:00+0000",), (LATE,)], "t string")
    times = times.withColumn("time", transaction_time("t"))
    assert times.where(in_window("time", EARLY, LATE)).count() == 3
    assert times.where(in_window("time", EARLY, LATE, "neither")).count() == 1
    assert times.where(in_window("time", EARLY, None, "neither")).count() == 2
    assert times.where(in_window("time", None, None, "neither")).count() == 3
    with pytest.raises(ValueError):
        in_window("time", EARLY, LATE, "left")


def test_address_network(transactions):
    found = address_network(transactions, EARLY, LATE)
    # An unusable input links to nothing, on either side.
    assert rows(found.edges) == [("A", "B"), ("B", "C"), ("E", "F"), ("I", "J"), ("L", "M"), ("M", "N")]
    assert rows(found.nodes) == [(a,) for a in "ABCDEFGHIJKLMNQ"]


def test_pairs_of_rows_match_nested(spark, sizes):
    listed = spark.createDataFrame(
        [("t", i, a) for i, a in enumerate("abcdefga")] + [("s", 0, "x"), ("s", 1, ""), ("s", 2, "y"), ("r", 0, "z")],
        "tx string, position int, address string",
    )
    expected = sorted(zip("abcdefg", "bcdefga", strict=True))
    assert rows(co_input_pairs_of_rows(listed, ["position"])) == expected


def test_users(transactions, sizes):
    network = address_network(transactions, EARLY, LATE)
    users = dict(rows(users_of(network)))
    assert users["A"] == users["B"] == users["C"] == 0
    assert users["L"] == users["M"] == users["N"]
    assert sorted(set(users.values())) == list(range(len(set(users.values()))))
    by_first = sorted({min(a for a in users if users[a] == u): u for u in users.values()}.items())
    assert [u for _, u in by_first] == sorted(u for _, u in by_first)


def test_user_network(transactions, sizes):
    users = users_of(address_network(transactions, EARLY, LATE)).cache()
    u = dict(rows(users))
    found = user_network(transactions, users, EARLY, LATE)
    pair = lambda a, b: tuple(sorted((u[a], u[b])))
    # A to D and D to A and B are one edge; the change to A and the bounds are left out.
    assert rows(found.edges.select("src", "dst", F.col("value").cast("int"), "count")) == sorted(
        [
            (*pair("A", "D"), 116, 3),
            (*pair("E", "G"), 4, 1),
            (*pair("Q", "G"), 6, 1),
        ]
    )
    assert {n for (n,) in rows(found.nodes)} == {u[a] for a in "ADEGIQ"}
    assert u["A"] == 0


def test_missing_address(spark, transactions):
    few = spark.createDataFrame([("A", 0), ("D", 1)], "address string, user_id long")
    paid = payments_of(transactions)
    with pytest.raises(MissingAddressError):
        with_users(paid, few)
    assert rows(missing_addresses(paid.where("sender = 'D'"), few)) == [("B",)]
    kept = with_users(paid, few, on_missing="drop")
    assert rows(kept.select("from_user", "to_user", F.col("value").cast("int"))) == [(0, 0, 7), (0, 1, 100), (1, 0, 5)]
    with pytest.raises(ValueError):
        with_users(paid, few, on_missing="ignore")


def test_payments_of_rows_match_nested(spark, transactions, sizes):
    numbered = transactions.withColumn("tx", F.monotonically_increasing_id()).cache()
    inputs = numbered.select("tx", F.posexplode("inputs")).select("tx", "pos", "col.address")
    outputs = numbered.select("tx", F.explode("outputs")).select("tx", "col.address", "col.value")
    listed = payments_of_rows(inputs, outputs, ["pos"])
    usable = F.col("sender").isNotNull()
    columns = ["sender", F.coalesce("receiver", F.lit("?")), F.coalesce(F.col("value").cast("int"), F.lit(-1))]
    assert rows(listed.where(usable), *columns) == rows(payments_of(numbered).where(usable), *columns)


def test_fold(transactions):
    users = users_of(address_network(transactions, EARLY, LATE)).cache()
    whole = user_network(transactions, users, EARLY, LATE)
    middle = "2012-06-19T04:29:41+0000"
    first = user_network(transactions.where(F.col("time") == transaction_time(F.lit(middle))), users, EARLY, LATE)
    rest = user_network(transactions.where(F.col("time") != transaction_time(F.lit(middle))), users, EARLY, LATE)
    folded = fold_payment_networks(first, rest)
    assert rows(folded.edges) == rows(whole.edges)
    assert rows(folded.nodes) == rows(whole.nodes)


def test_stored_networks(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    found = store_user_network(spark, folder, out, 2012, EARLY, LATE)
    path = f"{out}/{window_folder(2012, EARLY, LATE)}"
    # The stored address network is the co-input graph.
    assert rows(load_graph(spark, f"{path}/addresses").edges)[0] == ("A", "B")
    assert rows(load_address_users(spark, f"{path}/address_user")) == rows(found.address_user)
    assert rows(load_graph(spark, f"{path}/users").edges) == rows(found.users.edges)
    assert window_folder(2013) == "year=2013/window=all"


def test_stream(spark, folder, transactions, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stream"))
    users = users_of(address_network(transactions, EARLY, LATE)).cache()
    stream = stream_transactions(spark, folder, files_per_batch=1)
    for _ in range(2):
        payment_stream(stream, users, f"{out}/network", f"{out}/progress", EARLY, LATE).awaitTermination()
    whole = user_network(transactions, users, EARLY, LATE)
    found = streamed_network(spark, f"{out}/network")
    assert rows(found.edges) == rows(whole.edges)
    assert rows(found.nodes) == rows(whole.nodes)


def test_windows_of_a_copy_by_day(spark, folder, transactions, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("windows"))
    plain = store_user_network(spark, folder, f"{out}/plain", 2012, EARLY, LATE)
    copied = store_user_network(spark, folder, f"{out}/copied", 2012, EARLY, LATE, copy=f"{out}/copy")
    assert rows(copied.users.edges) == rows(plain.users.edges)
    assert rows(copied.addresses.nodes) == rows(plain.addresses.nodes)
    # Both ends lie within the data: one day is read, and the block files are not needed.
    day = ("2012-06-19T00:00:00+0000", "2012-06-19T23:00:00+0000")
    narrow = store_user_network(spark, f"{out}/none", f"{out}/copied", 2012, *day, copy=f"{out}/copy")
    wanted = address_network(transactions, *day)
    assert rows(narrow.addresses.edges) == rows(wanted.edges)
    assert rows(narrow.users.edges) == rows(user_network(transactions, users_of(wanted), *day).edges)
    plan = load_transactions(spark, f"{out}/copy", *day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    read = lambda *window: load_transactions(spark, f"{out}/copy", *window).select(F.input_file_name()).distinct().count()
    assert read(*day) == 1 < read()


def test_block_files_of_the_checks_are_compressed_and_whole(spark, tmp_path):
    from checks import queries, tables

    orders = spark.range(40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "timestamp'1996-01-02' AS o_orderdate", "if(id % 5 = 0, 'P', 'O') AS o_orderstatus", "'5-LOW' AS o_orderpriority")
    lines = spark.range(400).selectExpr("id % 40 AS l_orderkey", "id % 9 AS l_suppkey", "if(id % 2 = 0, 'O', 'F') AS l_linestatus", "id + 0.25D AS l_extendedprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    folder = queries._block_folder(spark, str(tmp_path))
    blocks = tables.purchases_as_blocks(spark, str(tmp_path))
    read = read_transactions(spark, folder, True).collect()
    assert len(read) == 400 and sorted(map(str, read)) == sorted(map(str, transactions_of(blocks).collect()))
    files = list(Path(folder).glob("part-*"))
    assert files and all(file.name.endswith(".json.gz") for file in files)
    plain = sum(len(line) + 1 for (line,) in blocks.select(F.to_json(F.struct("data"))).collect())
    assert sum(file.stat().st_size for file in files) < plain / 2
