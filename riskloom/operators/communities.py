"""Communities of many graphs at once, by merging along modularity gains.

Every node starts as a community. In a round each community names the neighbour it would gain most with, some of them move
into it, and the graph is contracted to the communities. Which ones move is settled so that modularity never falls:

* a community either moves or takes others in: its drawn number is above that of the neighbour it named, or it is not. It
  moves into the one that stays with which it gains most, among those it named or that named it.
* those that move into one community are dealt to cells that double in size. Each is held against the community's degree
  with all of its own and the smaller cells already in it, so the gain of all that pass is at least the sum of what was counted.

Cells are sums per community, at most ``CELLS`` rows each: no task holds all neighbours of one community. Draws are hashes.
Modularity is ``inner / 2m - sum(degree^2) / (2m)^2`` as in ``graphs.modularity``. The result is a maximum for merging:
no two communities gain by becoming one.

A graph of up to ``WHOLE_NODES`` nodes is one bounded group, and if the caller says so its task goes through all of its rounds at once, many graphs side
by side; a graph is alone in its rounds, so this gives the rows that rounds over tables give. Those take the larger graphs, and
the few that are not done after ``WHOLE_TURNS`` rounds.

Defined cases: a node without edges is a community; loops and repeated edges do not count; equal gains go by a drawn number
and then by name; an empty table gives no rows; edges whose ends are not among the nodes name communities that are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from riskloom.operators.graphs import both_ways
from riskloom.session import settle

CELLS = 24
SETTLED_EVERY = 5
WHOLE_NODES, WHOLE_TURNS = 512, 32


def _with_degrees(ends: DataFrame, degree: DataFrame) -> DataFrame:
    """Weighted ends ``(graph_id, node, other, w)`` with the degrees of both."""
    one = degree.select("graph_id", "node", "k", "two_m")
    two = degree.select("graph_id", F.col("node").alias("other"), F.col("k").alias("k_other"))
    return ends.join(one, ["graph_id", "node"]).join(two, ["graph_id", "other"])


def _drawn(turn: int, name: str) -> Column:
    return F.xxhash64(F.lit(turn), "graph_id", name)


def _proposals(ends: DataFrame, turn: int) -> DataFrame:
    """The neighbour each community gains most with, where it gains at all."""
    gain = F.col("w") * F.col("two_m") - F.col("k") * F.col("k_other")
    rated = ends.withColumn("gain", gain).where("gain > 0")
    best = F.max(F.struct("gain", _drawn(turn, "other").alias("tie"), "other", "w", "k", "k_other", "two_m"))
    named = rated.groupBy("graph_id", "node").agg(best.alias("b"))
    return named.select("graph_id", "node", "b.other", "b.w", "b.k", "b.k_other", "b.two_m")


def _moves(proposals: DataFrame, turn: int) -> DataFrame:
    """Moves ``(graph_id, node, other)`` of a round."""
    # numbers drawn for nodes differ from those that break ties; equal numbers go by name
    goes = F.struct(_drawn(-1 - turn, "node"), "node") > F.struct(_drawn(-1 - turn, "other"), "other")
    named = proposals.withColumn("goes", goes)
    # either end of a named pair may move into the other
    ends = F.explode(F.array(
        F.struct(F.col("node").alias("a"), F.col("other").alias("b"), F.col("k").alias("k"), F.col("k_other").alias("k_other")),
        F.struct(F.col("other").alias("a"), F.col("node").alias("b"), F.col("k_other").alias("k"), F.col("k").alias("k_other")),
    ))
    pairs = named.select("graph_id", "w", "two_m", ends.alias("e")).select("graph_id", "w", "two_m", "e.*")
    goers = named.where("goes").select("graph_id", F.col("node").alias("a"))
    stayers = named.where("not goes").select("graph_id", F.col("node").alias("b"))
    crossing = pairs.join(goers, ["graph_id", "a"], "left_semi").join(stayers, ["graph_id", "b"], "left_semi")
    gain = (F.col("w") * F.col("two_m") - F.col("k") * F.col("k_other")).alias("gain")
    best = F.max(F.struct(gain, _drawn(turn, "b").alias("tie"), "b", "w", "k", "k_other", "two_m")).alias("m")
    into = crossing.groupBy("graph_id", "a").agg(best)
    into = into.select("graph_id", F.col("a").alias("node"), F.col("m.b").alias("other"), "m.w", "m.k", "m.k_other", "m.two_m")
    # cell c holds a share of about 2 ** (c - CELLS) of those that move into one community
    share = (F.pmod(_drawn(turn, "node"), F.lit(1 << CELLS)) + 1).cast("double")
    placed = into.withColumn("cell", F.ceil(F.log2(share)).cast("int"))
    sums = placed.groupBy("graph_id", "other", "cell").agg(F.sum("k").alias("k_cell"))
    smaller = Window.partitionBy("graph_id", "other").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("k_before", F.sum("k_cell").over(smaller)).drop("k_cell")
    counted = placed.join(sums, ["graph_id", "other", "cell"])
    left = F.col("w") * F.col("two_m") - F.col("k") * (F.col("k_other") + F.col("k_before") - F.col("k"))
    return counted.where(left > 0).select("graph_id", "node", "other")


def _renamed(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    target = moves.select("graph_id", F.col("node").alias(column), F.col("other").alias("_to"))
    moved = rows.join(target, ["graph_id", column], "left")
    return moved.withColumn(column, F.coalesce("_to", column)).drop("_to")


def _contracted(ends: DataFrame, moves: DataFrame) -> DataFrame:
    """Ends between the communities after the moves; a community without ends cannot gain any more and is left out."""
    before = ends.groupBy("graph_id", "node").agg(F.max("k").alias("k"), F.max("two_m").alias("two_m"))
    degree = _renamed(before, moves, "node").groupBy("graph_id", "node").agg(F.sum("k").alias("k"), F.max("two_m").alias("two_m"))
    bare = _renamed(_renamed(ends.select("graph_id", "node", "other", "w"), moves, "node"), moves, "other")
    bare = bare.where("node <> other").groupBy("graph_id", "node", "other").agg(F.sum("w").alias("w"))
    return _with_degrees(bare, degree)


def _best(group: np.ndarray, gain: np.ndarray, tie: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The place of the greatest (gain, tie, name) of every group."""
    order = np.lexsort((name, tie, gain, group))
    return order[np.append(np.flatnonzero(np.diff(group[order])), len(order) - 1)] if len(order) else order


def _rounds(a: np.ndarray, b: np.ndarray, graph: np.ndarray, ties: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Community of every node, and the graphs that still gain after all turns, of nodes numbered by graph and name.

    The steps are those of ``_proposals``, ``_moves`` and ``_contracted``; ``ties`` and ``turns`` are the numbers drawn for a node.
    """
    n = len(graph)
    label, w = np.arange(n), np.ones(len(a))
    k = np.bincount(a, w, n)
    two_m = np.bincount(graph, k)[graph] if n else k
    for turn in range(ties.shape[1]):
        gain = w * two_m[a] - k[a] * k[b]
        rated = gain > 0
        if not rated.any():
            return label, np.zeros(0, np.int64)
        x, y, u = a[rated], b[rated], w[rated]
        tie, drawn = ties[:, turn], turns[:, turn]
        best = _best(x, gain[rated], tie[y], y)
        x, y, u = x[best], y[best], u[best]
        goes = (drawn[x] > drawn[y]) | ((drawn[x] == drawn[y]) & (x > y))
        goer, stayer = np.zeros(n, bool), np.zeros(n, bool)
        goer[x], stayer[x] = goes, ~goes
        x, y, u = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([u, u])
        crossing = goer[x] & stayer[y]
        x, y, u = x[crossing], y[crossing], u[crossing]
        best = _best(x, u * two_m[x] - k[x] * k[y], tie[y], y)
        x, y, u = x[best], y[best], u[best]
        share = (tie[x] & ((1 << CELLS) - 1)) + 1
        cell = np.ceil(np.log(share.astype(float)) / np.log(2.0)).astype(np.int64)
        order = np.lexsort((cell, y))
        x, y, u, cell = x[order], y[order], u[order], cell[order]
        before = np.cumsum(k[x])
        last = np.append((np.diff(y) != 0) | (np.diff(cell) != 0), True)[: len(x)]
        first = np.append(True, np.diff(y) != 0)[: len(x)]
        ends = np.flatnonzero(last)
        until = before[ends[np.searchsorted(ends, np.arange(len(x)))]] if len(x) else before
        start = np.flatnonzero(first)[np.cumsum(first) - 1] if len(x) else np.zeros(0, np.int64)
        until = until - (before[start] - k[x[start]])
        passed = u * two_m[x] - k[x] * (k[y] + until - k[x]) > 0
        target = np.arange(n)
        target[x[passed]] = y[passed]
        label, k = target[label], np.bincount(target, k, n)
        a, b = target[a], target[b]
        apart = a != b
        pairs, at = np.unique(a[apart] * n + b[apart], return_inverse=True)
        w = np.bincount(at, w[apart], len(pairs))
        a, b = pairs // max(n, 1), pairs % max(n, 1)
    return label, np.unique(graph[a[w * two_m[a] - k[a] * k[b] > 0]])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Communities of the listed nodes of whole graphs ``(graph_id, places, ends)``; graphs that are not done have none."""
    for batch in batches:
        names, listed, graph, starts, ties, turns, a, b = [], [], [], [], [], [], [], []
        for g, (places, ends) in enumerate(zip(batch["places"].to_pylist(), batch["ends"].to_pylist(), strict=True)):
            places.sort(key=lambda p: p["node"])
            number = {p["node"]: i for i, p in enumerate(places, len(names))}
            starts.append(len(names))
            names += number
            listed += [p["listed"] for p in places]
            graph += [g] * len(places)
            ties += [p["ties"] for p in places]
            turns += [p["turns"] for p in places]
            for e in ends or ():
                a.append(number[e["node"]])
                b.append(number[e["other"]])
        draws = [np.array(x, np.int64).reshape(len(names), -1) for x in (ties, turns)]
        graph, listed = np.array(graph, np.int64), np.array(listed, bool)
        label, open_graphs = _rounds(np.array(a, np.int64), np.array(b, np.int64), graph, *draws)
        least = np.full(len(names), len(names))
        np.minimum.at(least, label[listed], np.flatnonzero(listed))
        done = ~np.isin(graph, open_graphs)
        # one row stands for a graph that is not done
        kept = np.flatnonzero((listed & done) | (~done & np.isin(np.arange(len(names)), starts)))
        kind = batch["places"].type.value_type.field("node").type
        community = [names[least[label[i]]] if done[i] else None for i in kept]
        columns = [batch["graph_id"].take(pa.array(graph[kept])), pa.array([names[i] for i in kept], kind), pa.array(community, kind), pa.array(done[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["graph_id", "node", "community", "done"])


def communities(simple: DataFrame, nodes: DataFrame, whole_nodes: int = 0, whole_turns: int = WHOLE_TURNS) -> DataFrame:
    """``(graph_id, node, community)``: the community of every node, named by its least node.

    Graphs of up to ``whole_nodes`` nodes are taken whole; the rows are the same for any number.
    """
    if not whole_nodes:
        return _by_tables(simple, nodes)
    ends = both_ways(simple).distinct()
    places = nodes.select("graph_id", "node").distinct().withColumn("listed", F.lit(True))
    places = places.unionByName(ends.select("graph_id", "node", F.lit(False).alias("listed")))
    places = places.where("graph_id is not null and node is not null").groupBy("graph_id", "node").agg(F.max("listed").alias("listed"))
    sizes = settle(places.groupBy("graph_id").agg(F.count(F.lit(1)).alias("order")))
    small = sizes.where(F.col("order") <= whole_nodes).select("graph_id")
    every = F.sequence(F.lit(0), F.lit(whole_turns - 1))
    drawn = places.select(
        "graph_id",
        F.struct(
            "node",
            "listed",
            F.transform(every, lambda t: F.xxhash64(t, "graph_id", "node")).alias("ties"),
            F.transform(every, lambda t: F.xxhash64(-1 - t, "graph_id", "node")).alias("turns"),
        ).alias("place"),
    )
    lists = drawn.join(small, "graph_id", "left_semi").groupBy("graph_id").agg(F.collect_list("place").alias("places"))
    pairs = ends.join(small, "graph_id", "left_semi").groupBy("graph_id").agg(F.collect_list(F.struct("node", "other")).alias("ends"))
    fields = [nodes.schema["graph_id"], nodes.schema["node"], StructField("community", nodes.schema["node"].dataType)]
    schema = StructType([*fields, StructField("done", BooleanType())])
    rated = settle(lists.join(pairs, "graph_id", "left").select("graph_id", "places", "ends").mapInArrow(_whole, schema))
    found = rated.where("done").drop("done")
    rest = settle(sizes.where(F.col("order") > whole_nodes).select("graph_id").unionByName(rated.where("not done").select("graph_id")))
    if rest.isEmpty():
        return found
    return found.unionByName(_by_tables(simple.join(rest, "graph_id", "left_semi"), nodes.join(rest, "graph_id", "left_semi")))


def _by_tables(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """The communities of graphs of any size.

    Rounds go on until no merge gains. Each is a fixed number of joins and groupings over the contracted graph, and the draws
    are new in each, so that a move that was held back is tried again under others.
    """
    labels = nodes.select("graph_id", "node").distinct().withColumn("community", F.col("node"))
    ends = both_ways(simple).groupBy("graph_id", "node", "other").agg(F.lit(1.0).alias("w"))
    degree = ends.groupBy("graph_id", "node").agg(F.sum("w").alias("k"))
    total = degree.groupBy("graph_id").agg(F.sum("k").alias("two_m"))
    ends, turn = settle(_with_degrees(ends, degree.join(total, "graph_id"))), 0
    while True:
        proposals = settle(_proposals(ends, turn))
        if proposals.isEmpty():
            break
        moves = settle(_moves(proposals, turn))
        labels = _renamed(labels, moves, "community")
        ends, turn = settle(_contracted(ends, moves)), turn + 1
        if turn % SETTLED_EVERY == 0:
            labels = settle(labels)
    labels = settle(labels)
    least = labels.groupBy("graph_id", "community").agg(F.min("node").alias("least"))
    return labels.join(least, ["graph_id", "community"]).select("graph_id", "node", F.col("least").alias("community"))
