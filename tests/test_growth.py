"""Networks that grow load by load, and the folders they are kept in."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_blocks import BLOCKS, EARLY, LATE, tx

from kithwatch.operators.address_network import address_network
from kithwatch.operators.payment_network import user_network
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import dense_ids, ordered
from kithwatch.plans.growing import GrowingNetwork
from kithwatch.plans.users import users_of
from kithwatch.sources.blocks import BLOCK_SCHEMA, read_transactions, stream_transactions, transactions_of
from kithwatch.sources.generations import Generations
from kithwatch.streaming.payments import grown_network, network_stream, payment_stream, streamed_network


def table(spark, transactions):
    blocks = spark.createDataFrame([(json.dumps({"data": transactions}),)], "block string")
    return transactions_of(blocks.select(F.from_json("block", BLOCK_SCHEMA).alias("block")).select("block.*"))


def one_run(transactions, start=None, end=None):
    network = address_network(transactions, start, end)
    users = users_of(network)
    return network, users, user_network(transactions, users, start, end)


def same(grown, wanted):
    network, users, paid = wanted
    assert rows(grown.addresses.nodes) == rows(network.nodes)
    assert rows(grown.addresses.edges) == rows(network.edges)
    assert rows(grown.address_user) == rows(users)
    assert rows(grown.users.nodes) == rows(paid.nodes)
    assert rows(grown.users.edges, "src", "dst", "value", "count") == rows(paid.edges, "src", "dst", "value", "count")


def random_transactions(count, seed):
    rng = random.Random(seed)
    names = [f"{rng.choice('abcxyz')}{i}" for i in range(45)]
    made = []
    for _ in range(count):
        inputs = rng.sample(names, rng.choice([1, 1, 1, 2, 2, 3]))
        outputs = [(rng.choice([*names, "", None]), rng.randint(1, 99)) for _ in range(rng.randint(0, 3))]
        time = rng.choice([EARLY, LATE, "2012-06-19T04:29:41+0000", "2012-08-01T00:00:00+0000"])
        made.append(tx(inputs, outputs, time, rng.choice([0, 3, 3, 3]), rng.random() < 0.1))
    return made


def test_loads_in_any_order_equal_one_run(spark, tmp_path):
    made = random_transactions(60, 1)
    wanted = one_run(table(spark, made).cache(), EARLY, LATE)
    random.Random(1).shuffle(made)
    loads = [made[:25], [], made[25:40], made[40:]]
    grown = GrowingNetwork(spark, f"{tmp_path}/network", EARLY, LATE, fold_every=3)
    for number, load in enumerate(loads):
        grown.add(table(spark, load), number)
    same(grown.network(), wanted)


def test_users_become_one(spark, tmp_path):
    first = [tx(["b", "c"], [("x", 5)]), tx(["x"], [("c", 2), ("m", 4)]), tx(["m"], [("b", 1)])]
    second = [tx(["x", "a"], [("m", 9)])]
    third = [tx(["c", "x"], []), tx(["a"], [("z", 3)])]
    spark.conf.set("spark.kithwatch.hotRows", "3")
    spark.conf.set("spark.kithwatch.windowRows", "3")
    grown = GrowingNetwork(spark, f"{tmp_path}/network")
    for number, load in enumerate([first, second, third]):
        grown.add(table(spark, load), number)
    found = grown.network()
    spark.conf.unset("spark.kithwatch.hotRows")
    spark.conf.unset("spark.kithwatch.windowRows")
    same(found, one_run(table(spark, first + second + third)))
    # b and x had become a; what they paid each other is change now.
    users = dict(rows(found.address_user))
    assert users == {"a": 0, "b": 0, "c": 0, "x": 0, "m": 1, "z": 2}


def test_a_load_is_added_once(spark, tmp_path):
    grown = GrowingNetwork(spark, f"{tmp_path}/network")
    load = table(spark, [tx(["a"], [("b", 5)])])
    for _ in range(3):
        grown.add(load, 7)
    assert rows(grown.network().users.edges.select("src", "dst", F.col("value").cast("int"), "count")) == [(0, 1, 5, 1)]


def test_streamed_networks(spark, tmp_path):
    folder = tmp_path / "blocks"
    folder.mkdir()
    for number, block in enumerate([*BLOCKS, [tx(["A", "E"], [("Q", 2)])], [tx(["Q"], [("A", 1)])]]):
        (folder / f"block-{number}.json").write_text(json.dumps({"data": block}))
    stream = stream_transactions(spark, str(folder), files_per_batch=1)
    for _ in range(2):
        network_stream(stream, f"{tmp_path}/network", f"{tmp_path}/progress", EARLY, LATE, fold_every=2).awaitTermination()
    whole = read_transactions(spark, str(folder)).cache()
    wanted = one_run(whole, EARLY, LATE)
    same(grown_network(spark, f"{tmp_path}/network"), wanted)
    payment_stream(stream, wanted[1].cache(), f"{tmp_path}/paid", f"{tmp_path}/paid-progress", EARLY, LATE, fold_every=2).awaitTermination()
    found = streamed_network(spark, f"{tmp_path}/paid")
    assert rows(found.edges) == rows(wanted[2].edges) and rows(found.nodes) == rows(wanted[2].nodes)


# Folders


def grow(spark, path, every, batches):
    """Batch n adds rows (n, 1); folding adds them up."""
    stored = Generations(spark, path, {"t": "k long, n long", "newest": "k long"}, latest=["newest"])
    for batch in batches:
        part = spark.createDataFrame([(batch % 5, 1)], "k long, n long")
        now = stored.append(batch, {"t": part, "newest": part.select("k")})
        if len(now.parts) >= every:
            stored.fold({"t": total(stored), "newest": stored.read("newest")})
    return stored


def total(stored):
    return stored.read("t").groupBy("k").agg(F.sum("n").alias("n"))


def test_many_batches_leave_few_folders(spark, tmp_path):
    stored = grow(spark, str(tmp_path), 6, range(25))
    assert rows(total(stored)) == [(k, 5) for k in range(5)]
    assert rows(stored.read("newest")) == [(24 % 5,)]
    assert len(list(tmp_path.iterdir())) <= 2 * (6 + 1) + 1
    assert len([f for f in (tmp_path / "manifest").iterdir() if f.suffix == ".json"]) <= 6 + 2


class Crash(Exception):
    pass


@pytest.mark.parametrize(
    ("step", "late"),
    [("_write", False), ("_save", False), ("_switch", False), ("_sweep", False), ("_delete", False), ("_write", True), ("_switch", True)],
)
def test_a_crash_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step, late):
    """The writer dies before or after a step, at the first and at a later time, and starts again."""
    plain, calls = getattr(Generations, step), {"n": 0, "at": 2}

    def failing(self, *given):
        calls["n"] += 1
        done = plain(self, *given) if late else None
        if calls["n"] == calls["at"]:
            raise Crash
        return done if late else plain(self, *given)

    monkeypatch.setattr(Generations, step, failing)
    done = 0
    for at in (2, 3, 5, 99):
        calls.update(n=0, at=at)
        try:
            # A stream runs the batch again whose end it has not noted.
            for batch in range(done, 9):
                grow(spark, str(tmp_path), 3, [batch])
                done = batch + 1
        except Crash:
            pass
    assert done == 9
    stored = grow(spark, str(tmp_path), 3, [])
    assert rows(total(stored)) == [(k, 2) for k in range(4)] + [(4, 1)]


def test_readers_keep_what_they_planned_with(spark, tmp_path):
    stored = grow(spark, str(tmp_path), 4, range(3))
    planned = total(stored)
    grow(spark, str(tmp_path), 4, [3])
    assert rows(planned) == [(0, 1), (1, 1), (2, 1)]
    assert rows(total(stored)) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    with pytest.raises(ValueError):
        stored.append(9, {"t": planned})
    assert rows(total(Generations(spark, str(tmp_path)))) == rows(total(stored))
    with pytest.raises(FileNotFoundError):
        Generations(spark, f"{tmp_path}/none")


def test_links_of_a_transaction_settle_at_once(spark, tmp_path, monkeypatch):
    names = [f"n{i:03d}" for i in range(200)]
    random.Random(3).shuffle(names)
    parted = ["p", "q", "", "r", "s", None, "n007"]
    made = [tx(names, [("out", 1)]), tx(parted, [("p", 2)]), tx(["out"], [("s", 3)])]
    wanted = one_run(table(spark, made))
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda scratch, rows, name: (saved.append(name), save(scratch, rows, name))[1])
    grown = GrowingNetwork(spark, f"{tmp_path}/network")
    grown.add(table(spark, made), 0)
    # Stars are settled from the start, which the first round sees.
    assert sum(name.startswith("round-") and name != "round-0" for name in saved) == 1
    grown.add(table(spark, [tx(["out", "r"], [("q", 4)])]), 1)
    monkeypatch.undo()
    same(grown.network(), one_run(table(spark, [*made, tx(["out", "r"], [("q", 4)])])))
    assert dict(rows(wanted[1]))["n007"] == dict(rows(wanted[1]))["n000"]


def test_numbers_need_one_shuffle(spark, tmp_path):
    keys = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "key string").repartition(4)
    scratch = Scratch(spark, "numbers")
    found = dense_ids(keys, "key", "n", scratch, "keys")
    assert rows(found.where("key is not null"), "n", "key") == [(1, "a"), (2, "b"), (3, "c")]
    # Only the sizes of the ranges are gathered; the rows stay where they were sorted.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "row_number" not in plan
    placed = ordered(keys.dropna(), ["key"], "n", scratch, "ordered").collect()
    assert [row["key"] for row in sorted(placed, key=lambda row: row["n"])] == ["a", "b", "c"]
