import random

import brute
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch.graph import Graph
from kithwatch.operators import girvan_newman, louvain
from kithwatch.operators.communities import detect_communities, from_lists
from kithwatch.operators.components import connected_components
from kithwatch.operators.girvan_newman import edge_betweenness, girvan_newman_communities
from kithwatch.operators.louvain import louvain_communities
from kithwatch.operators.modularity import modularity


def graph(spark, nodes, edges, weight=None):
    kind = "string" if isinstance(nodes[0], str) else "long"
    pairs = sorted({tuple(sorted(e)) for e in edges})
    table = spark.createDataFrame(pairs, f"src {kind}, dst {kind}")
    if weight:
        table = spark.createDataFrame(
            [(a, b, weight[(a, b)]) for a, b in pairs], f"src {kind}, dst {kind}, weight double"
        )
    return Graph(spark.createDataFrame([(n,) for n in nodes], f"id {kind}"), table), pairs


def random_edges(count, links, seed):
    rng = random.Random(seed)
    return [tuple(rng.sample(range(count), 2)) for _ in range(links)]


def test_components_of_random_graphs(spark, sizes):
    nodes = list(range(60))
    g, pairs = graph(spark, nodes, random_edges(60, 45, 1))
    assert rows(connected_components(g.nodes, g.edges)) == brute.components(nodes, pairs)


def test_components_of_a_long_chain_and_a_hub(spark, sizes):
    order = list(range(70))
    random.Random(3).shuffle(order)
    chain = list(zip(order, order[1:], strict=False))
    hub = [(200, 201 + i) for i in range(40)]
    nodes = [*order, *range(200, 241), 300]
    g, pairs = graph(spark, nodes, chain + hub)
    assert rows(connected_components(g.nodes, g.edges)) == brute.components(nodes, pairs)


def test_components_of_names_without_edges(spark):
    g, _ = graph(spark, ["b", "a"], [("a", "a")])
    assert rows(connected_components(g.nodes, g.edges)) == [("a", "a"), ("b", "b")]


def test_components_give_up(spark):
    g, _ = graph(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)])
    with pytest.raises(RuntimeError):
        connected_components(g.nodes, g.edges, max_rounds=1)


def test_modularity(spark, sizes):
    nodes = list(range(20))
    pairs = sorted({tuple(sorted(e)) for e in random_edges(20, 40, 5)} | {(3, 3)})
    weight = {e: 1.0 + (e[0] % 3) for e in pairs}
    g, _ = graph(spark, nodes, pairs, weight)
    label = {n: n % 4 for n in nodes}
    communities = spark.createDataFrame(list(label.items()), "node long, community long")
    found = modularity(g.edges, communities).first()[0]
    assert found == pytest.approx(brute.modularity(pairs, label, weight), abs=1e-12)
    plain = modularity(g.edges.select("src", "dst"), communities).first()[0]
    assert plain == pytest.approx(brute.modularity(pairs, label), abs=1e-12)


def cliques(count, size):
    edges = []
    for c in range(count):
        members = range(c * size, (c + 1) * size)
        edges += [(a, b) for a in members for b in members if a < b]
        edges.append((c * size, ((c + 1) % count) * size + 1))
    return edges


def test_louvain_finds_cliques(spark, sizes):
    nodes = [*range(20), 99]
    g, pairs = graph(spark, nodes, cliques(4, 5))
    found = rows(louvain_communities(g.nodes, g.edges))
    assert [n for n, _ in found] == nodes
    label = dict(found)
    assert [label[n] for n in range(20)] == [n // 5 for n in range(20)]
    assert label[99] == 4


def test_louvain_is_repeatable(spark):
    nodes = list(range(20))
    g, pairs = graph(spark, nodes, random_edges(20, 36, 8))
    first = rows(louvain_communities(g.nodes, g.edges))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = rows(louvain_communities(g.nodes.repartition(5), g.edges.repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again
    label = dict(first)
    assert brute.modularity(pairs, label) > brute.modularity(pairs, {n: n for n in nodes}) + 0.2


def test_louvain_follows_weights(spark):
    ring = [(0, 1), (1, 2), (2, 3), (0, 3)]
    g, _ = graph(spark, [0, 1, 2, 3], ring, {(0, 1): 10.0, (1, 2): 1.0, (2, 3): 10.0, (0, 3): 1.0})
    assert dict(rows(louvain_communities(g.nodes, g.edges))) == {0: 0, 1: 0, 2: 1, 3: 1}


def test_louvain_needs_no_rounds_for_light_components(spark, sizes, monkeypatch):
    """Chains, circles and a loop end as they hang together; cliques and a link of no weight go through the rounds."""
    offered = []
    settle = louvain._settle
    monkeypatch.setattr(louvain, "_settle", lambda level, *given: offered.append(level.members) or settle(level, *given))
    chains = [(100 + 10 * c + i, 101 + 10 * c + i) for c in range(20) for i in range(1 + c % 5)]
    circles = [(1000 + 10 * c + i, 1000 + 10 * c + (i + 1) % 4) for c in range(10) for i in range(4)]
    weight = {(2000, 2001): 3.0, (2001, 2002): 0.0, (3000, 3000): 2.0, (3001, 3002): 0.5}
    edges = cliques(4, 5) + chains + circles
    nodes = sorted({n for e in [*edges, *weight] for n in e} | {99})
    pairs = {tuple(sorted(e)): 1.0 for e in edges} | weight
    g, _ = graph(spark, nodes, list(pairs), pairs)
    label = dict(rows(louvain_communities(g.nodes, g.edges)))
    assert offered[0] == 20 + 3
    parts = dict(brute.components(nodes, [e for e in pairs if e != (2001, 2002)]))
    wanted = {n: n // 5 if n < 20 else parts[n] + 20 for n in nodes}
    names = {c: i for i, c in enumerate(sorted(set(wanted.values())))}
    assert label == {n: names[wanted[n]] for n in nodes}
    offered.clear()
    few = spark.createDataFrame(chains, "src long, dst long")
    ends = few.selectExpr("explode(array(src, dst)) AS id").distinct()
    assert len(set(dict(rows(louvain_communities(ends, few))).values())) == 20
    assert not offered


def test_louvain_of_a_light_component_is_the_best_there_is(spark):
    """No way to cut a component that needs no rounds is better."""
    edges = [(0, 1), (1, 2), (2, 3), (1, 3), (3, 4)] + [(10 + 2 * c, 11 + 2 * c) for c in range(9)]
    nodes = [*range(5), *range(10, 28)]
    g, pairs = graph(spark, nodes, edges)
    label = dict(rows(louvain_communities(g.nodes, g.edges)))
    reached = brute.modularity(pairs, label)
    for cut in range(1, 31):
        assert brute.modularity(pairs, label | {n: 100 + (cut >> n & 1) for n in range(5)}) <= reached + 1e-12


def test_betweenness(spark, sizes):
    nodes = list(range(14))
    g, pairs = graph(spark, nodes, random_edges(14, 20, 4))
    expected = brute.betweenness(nodes, pairs)
    found = {(a, b): value for a, b, value in rows(edge_betweenness(g.nodes, g.edges))}
    assert found == pytest.approx(expected)


@pytest.mark.parametrize("rows_at_once", [1, 60])
def test_betweenness_in_batches(spark, rows_at_once):
    nodes = list(range(13))
    g, pairs = graph(spark, nodes, [*random_edges(9, 12, 6), (10, 11), (11, 11)])
    found = {(a, b): value for a, b, value in rows(edge_betweenness(g.nodes, g.edges, rows_at_once))}
    assert found == pytest.approx(brute.betweenness(nodes, pairs))


@pytest.mark.parametrize(
    "edges, searched",
    [
        # A circle of four with a leaf, a chain, and a tree on it, beside a pair and a tree.
        ([(0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (1, 5), (5, 6), (6, 7), (2, 8), (8, 9), (8, 10), (12, 13), (14, 15), (14, 16), (16, 17)], 4),
        # Two circles held by a chain, which is part of what is searched.
        ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (4, 6), (3, 7), (9, 9)], 7),
        # A tree needs no search.
        ([(0, i) for i in range(1, 9)] + [(8, 9), (9, 10)], 0),
    ],
)
def test_betweenness_folds_trees(spark, sizes, monkeypatch, edges, searched):
    started = []
    search = girvan_newman._search

    def watched(sources, links, scratch):
        started.append(sources.count())
        return search(sources, links, scratch)

    monkeypatch.setattr(girvan_newman, "_search", watched)
    nodes = list(range(18))
    g, pairs = graph(spark, nodes, edges)
    found = {(a, b): value for a, b, value in rows(edge_betweenness(g.nodes, g.edges))}
    assert found == pytest.approx(brute.betweenness(nodes, pairs))
    assert sum(started) == searched


def test_betweenness_folds_nodes_that_are_not_listed(spark, sizes):
    """A node that the table does not list ends paths but starts none."""
    g, pairs = graph(spark, [0, 1, 2, 4, 5, 8], [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (0, 5), (5, 6), (5, 7), (8, 9)])
    found = {(a, b): value for a, b, value in rows(edge_betweenness(g.nodes, g.edges))}
    assert found == pytest.approx(brute.betweenness([0, 1, 2, 4, 5, 8], pairs))


def test_betweenness_of_a_chain_keeps_plans_small(spark):
    nodes = list(range(12))
    g, pairs = graph(spark, nodes, list(zip(nodes, nodes[1:], strict=False)))
    found = edge_betweenness(g.nodes, g.edges)
    assert rows(found) == [(i, i + 1, float((i + 1) * (11 - i))) for i in range(11)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def split_by_hand(nodes, pairs):
    """Sets of nodes after the first split, and the removals it took."""
    start = len({c for _, c in brute.components(nodes, pairs)})
    pairs, removed = list(pairs), 0
    while pairs:
        scores = brute.betweenness(nodes, pairs)
        top = min(pairs, key=lambda e: (-round(scores[e], 6), e))
        pairs.remove(top)
        removed += 1
        if len({c for _, c in brute.components(nodes, pairs)}) > start:
            break
    return dict(brute.components(nodes, pairs)), removed


def test_girvan_newman_of_several_removals(spark, crossing=5):
    """Two groups held together by several links, beside a third that is never searched again."""
    groups = [(a, b) for base in (0, 6) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    edges = groups + [(i, 6 + i) for i in range(crossing)] + [(20, 21), (21, 22), (20, 22)]
    nodes = [*range(12), 20, 21, 22, 30]
    g, pairs = graph(spark, nodes, edges)
    wanted, removed = split_by_hand(nodes, pairs)
    assert removed == crossing
    names = {name: i for i, name in enumerate(sorted(set(wanted.values())))}
    assert rows(girvan_newman_communities(g.nodes, g.edges)) == [(n, names[wanted[n]]) for n in nodes]


def test_girvan_newman_searches_components_once(spark, monkeypatch):
    """A square with a leaf: components at the start, for its folded edge, and after either removal."""
    made = []
    search = girvan_newman.connected_components
    monkeypatch.setattr(girvan_newman, "connected_components", lambda *given: made.append(1) or search(*given))
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (0, 4)]
    g, pairs = graph(spark, list(range(5)), edges)
    wanted, removed = split_by_hand(list(range(5)), pairs)
    names = {name: i for i, name in enumerate(sorted(set(wanted.values())))}
    assert rows(girvan_newman_communities(g.nodes, g.edges)) == [(n, names[wanted[n]]) for n in range(5)]
    assert len(made) == 2 + removed


def test_girvan_newman_of_a_random_graph(spark, seed=11):
    nodes = list(range(16))
    g, pairs = graph(spark, nodes, [*random_edges(9, 13, seed), (10, 11), (11, 12), (10, 12), (12, 13), (13, 14)])
    wanted, _ = split_by_hand(nodes, pairs)
    names = {name: i for i, name in enumerate(sorted(set(wanted.values())))}
    assert rows(girvan_newman_communities(g.nodes, g.edges)) == [(n, names[wanted[n]]) for n in nodes]


def test_girvan_newman(spark):
    bridge = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    g, _ = graph(spark, list(range(6)), bridge)
    assert rows(girvan_newman_communities(g.nodes, g.edges)) == [(n, n // 3) for n in range(6)]
    alone, _ = graph(spark, [7, 8], [(7, 7)])
    assert rows(girvan_newman_communities(alone.nodes, alone.edges)) == [(7, 0), (8, 1)]
    # A square has no bridge, so two edges must go.
    square, _ = graph(spark, [0, 1, 2, 3], [(0, 1), (1, 2), (2, 3), (0, 3)])
    assert rows(girvan_newman_communities(square.nodes, square.edges).select("community").distinct()) == [(0,), (1,)]


def test_methods(spark):
    g, _ = graph(spark, [0, 1], [(0, 1)])
    with pytest.raises(ValueError):
        detect_communities(g, "spectral")
    assert rows(detect_communities(g, "louvain")) == [(0, 0), (1, 0)]


def test_lists(spark):
    lists = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"])], "position int, members array<string>")
    assert rows(from_lists(lists, "position", "members")) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(lists.select(F.size("members"))) == [(2,), (2,)]
