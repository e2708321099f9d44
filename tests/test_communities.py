"""Communities: planted ones are found, modularity never falls, hubs do not stall the merging."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from riskloom.operators import communities as found_communities
from riskloom.operators.graphs import modularity, simple_edges

EDGES, NODES = "graph_id string, src string, dst string", "graph_id string, node string"


def found(spark, edges, nodes=None):
    named = {(g, n) for g, *ends in edges for n in ends} | set(nodes or [])
    simple = simple_edges(spark.createDataFrame(edges, EDGES))
    listed = spark.createDataFrame(sorted(named), NODES)
    return simple, found_communities.communities(simple, listed)


def quality(edges, community):
    """Modularity by the definition, pair of ends by pair of ends."""
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    degree, two_m = {}, 2 * len(pairs)
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inner = sum(2 for a, b in pairs if community[a] == community[b])
    chance = sum(degree[a] * degree[b] for a in degree for b in degree if community[a] == community[b])
    return inner / two_m - chance / two_m**2


def planted(rng, groups, size, inside, outside):
    names = [f"{g}-{i}" for g in range(groups) for i in range(size)]
    rate = lambda a, b: inside if a.split("-")[0] == b.split("-")[0] else outside
    return [(a, b) for a, b in combinations(names, 2) if rng.random() < rate(a, b)]


def test_cliques_and_planted_groups_are_found(spark):
    rng = random.Random(4)
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i, j in combinations(range(6), 2)]
    ring = cliques + [("a0", "b1"), ("b0", "c1"), ("c0", "d1"), ("d0", "a1")]
    dense = planted(rng, 4, 24, 0.7, 0.02)
    edges = [("ring", *e) for e in ring] + [("dense", *e) for e in dense] + [("ring", "a0", "a0"), ("ring", "a1", "a0")]
    simple, result = found(spark, edges, [("ring", "alone"), ("bare", "x")])
    by_graph = {}
    for r in result.collect():
        assert r.node not in by_graph.setdefault(r.graph_id, {})
        by_graph[r.graph_id][r.node] = r.community
    assert by_graph["bare"] == {"x": "x"} and by_graph["ring"].pop("alone") == "alone"
    assert all(c == f"{n[0]}0" for n, c in by_graph["ring"].items())
    truth = {n: n.split("-")[0] for n in by_graph["dense"]}
    assert quality(dense, by_graph["dense"]) > 0.9 * quality(dense, truth)
    given = {r.graph_id: r.modularity for r in modularity(simple, result).collect()}
    for name, pairs in (("ring", ring), ("dense", dense)):
        assert given[name] == pytest.approx(quality(pairs, by_graph[name]), abs=1e-12)


def test_no_merge_is_left_and_modularity_never_falls(spark, monkeypatch):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    pairs = [(str(a), str(b)) for a, b in pairs]
    steps, community = [], {n: n for e in pairs for n in e}
    original = found_communities._moves

    def watched(proposals, turn):
        moves = original(proposals, turn)
        to = {r.node: r.other for r in moves.collect()}
        community.update({n: to.get(c, c) for n, c in community.items()})
        steps.append(quality(pairs, community))
        return moves

    monkeypatch.setattr(found_communities, "_moves", watched)
    before = quality(pairs, community)
    _, result = found(spark, [("g", *e) for e in pairs])
    final = {r.node: r.community for r in result.collect()}
    assert all(b >= a - 1e-12 for a, b in zip([before, *steps], steps, strict=False)) and steps[-1] > before
    assert quality(pairs, final) == pytest.approx(steps[-1], abs=1e-12)
    for a, b in combinations(sorted(set(final.values())), 2):
        assert quality(pairs, {n: a if c == b else c for n, c in final.items()}) <= steps[-1] + 1e-12


def test_a_hub_with_many_leaves(spark):
    leaves = [("star", "hub", f"leaf{i}") for i in range(3000)] + [("pair", "p", "q")]
    _, result = found(spark, leaves)
    rows = result.collect()
    assert len(rows) == 3003
    star = {r.node: r.community for r in rows if r.graph_id == "star"}
    assert len({c for n, c in star.items()}) == 1  # by the law every leaf gains in the hub's community
    assert {r.community for r in rows if r.graph_id == "pair"} == {"p"}


def test_empty_tables(spark):
    simple = simple_edges(spark.createDataFrame([], EDGES))
    assert found_communities.communities(simple, spark.createDataFrame([], NODES)).collect() == []


@pytest.mark.parametrize("turns", [1, 3, 32])
def test_graphs_taken_whole_give_the_rows_of_tables(spark, turns):
    """Small graphs in their task, larger ones and those not done after ``turns`` rounds by tables (F4, F7)."""
    rng = random.Random(12)
    edges = [("big", *e) for e in planted(rng, 3, 12, 0.7, 0.05)] + [("ring", f"é{i}", f"é{(i + 1) % 9}") for i in range(9)]
    for g in range(60):
        edges += [(f"g{g}", *map(str, rng.sample(range(20), 2))) for _ in range(rng.randrange(40))]
    listed = [("bare", "x"), ("ring", "alone"), *[(g, n) for g, *ends in edges for n in ends if n != "7"]]
    simple = simple_edges(spark.createDataFrame(edges, EDGES))
    nodes = spark.createDataFrame(sorted(set(listed)), NODES)
    tables = found_communities.communities(simple, nodes)
    whole = found_communities.communities(simple, nodes, 30, turns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, tables.collect()))


def test_few_jobs_for_many_small_graphs(spark):
    """Rounds of small graphs take no rounds of jobs (F4, F7)."""
    rng, calls = random.Random(3), []
    edges = [(f"g{g}", *map(str, rng.sample(range(20), 2))) for g in range(50) for _ in range(30)]
    simple = simple_edges(spark.createDataFrame(edges, EDGES))
    nodes = simple.select("graph_id", "src").union(simple.select("graph_id", "dst")).toDF("graph_id", "node")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(found_communities, "_proposals", lambda *a: calls.append(a))
        assert found_communities.communities(simple, nodes, found_communities.WHOLE_NODES).count() == nodes.distinct().count()
    assert not calls


def test_cells_are_those_of_the_tables(spark):
    shares = [1, 2, 3, 4, 5, 7, 8, 9, *[2**i + d for i in range(4, 24) for d in (-1, 0, 1)], 2**24]
    found = spark.createDataFrame([(float(x),) for x in shares], "x double").selectExpr("x", "CAST(ceil(log2(x)) AS INT) c").collect()
    assert all(int(np.ceil(np.log(r.x) / np.log(2.0))) == r.c for r in found)
