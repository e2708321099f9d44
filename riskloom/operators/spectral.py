"""Both ends of the Laplacian spectrum, Fiedler vectors and energies of many graphs at once, of any size.

A graph of up to ``dense`` nodes is one group of bounded size and is solved whole in its task. Larger graphs stay tables keyed by
(graph, node), so one graph may hold any share of the rows:

* the low end starts on a coarse graph: nodes merge with the neighbour they are tied to most, as joins, level by level until
  a graph is small enough to be solved whole. Its lowest vectors are handed down, and on every level a Chebyshev filter of the
  matrix and a Rayleigh-Ritz step over the block refine them;
* the high end takes the same rounds on ``c - L``, from hashed starts;
* the energy is a stochastic trace: even Chebyshev moments of hashed sign vectors.

Rounds are bounded. What is left of the error is reported per value: a true eigenvalue lies within ``error`` of each, and where
the block is well apart from the rest of the spectrum the bound is quadratic in the residual.

Nodes or ends that are null belong to no graph; a graph without edges has only zeros; equal eigenvalues are all listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graphs import both_ways, component_counts, components, degrees
from riskloom.operators.ordering import join_many_to_one
from riskloom.session import settle

KEPT_EIGENVALUES = 20
DENSE = 512  # nodes of a graph that one task solves
GUARD = 4  # vectors in a block beyond the wanted ones
DEGREE, SETTLED = 12, 12  # products in a filter, and in one plan
ROUNDS, COARSE_ROUNDS = 5, 1
TOLERANCE = 1e-6  # bound of the error of a value, against the bound of the spectrum
HUB_CELLS = 200_000  # cells of one node in one task
SLICE_NODES = 20_000  # nodes that are rotated together
PROBES, MOMENTS = 16, 24


def _key(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _usable(simple: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = nodes.where("graph_id is not null and node is not null").select("graph_id", "node").distinct()
    return simple.where("graph_id is not null and src is not null and dst is not null"), named


def _orders(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("order"))


# ---- graphs of bounded size, whole


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node names in order, weights between them, masses) of rows (node, other, w); a node's own row holds its mass."""
    ends = [group[c].to_numpy(zero_copy_only=False) for c in ("node", "other")]
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    row, col = at[: len(ends[0])], at[len(ends[0]) :]
    w = np.zeros((len(names), len(names)))
    np.add.at(w, (row, col), group["w"].to_numpy(zero_copy_only=False))
    mass = np.diag(w).copy()
    np.fill_diagonal(w, 0.0)
    return names, w, mass


def _signed(vector: np.ndarray) -> np.ndarray:
    """The vector with its first entry of some weight positive."""
    heavy = np.flatnonzero(np.abs(vector) > 1e-6 * max(np.abs(vector).max(), 1e-300))
    return vector if not len(heavy) or vector[heavy[0]] > 0 else -vector


def _whole(graph_type: str, node_type: str) -> tuple[Callable[[pa.Table], pa.Table], str]:
    schema = (
        f"graph_id {graph_type}, order bigint, values array<double>, lambda_max double, energy double, "
        f"nodes array<{node_type}>, fiedler array<double>"
    )

    def solve(group: pa.Table) -> pa.Table:
        names, w, _ = _gathered(group)
        values, vectors = np.linalg.eigh(np.diag(w.sum(axis=1)) - w)
        values = np.maximum(values, 0.0)
        second = _signed(vectors[:, 1]) if len(values) > 1 else np.zeros(0)
        node = group["node"].type
        columns = {
            "graph_id": group["graph_id"][:1].combine_chunks(),
            "order": pa.array([len(names)], pa.int64()),
            "values": pa.array([values.tolist()], pa.list_(pa.float64())),
            "lambda_max": pa.array([float(values[-1])]),
            "energy": pa.array([float(np.abs(np.linalg.eigvalsh(w)).sum())]),
            "nodes": pa.array([names.tolist()], pa.list_(node)),
            "fiedler": pa.array([second.tolist()], pa.list_(pa.float64())),
        }
        return pa.table(columns)

    return solve, schema


def _own_rows(nodes: DataFrame, mass: Column) -> DataFrame:
    return nodes.select("graph_id", "node", F.col("node").alias("other"), mass.cast("double").alias("w"))


def solved_whole(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per graph, all of bounded size: order, all values, largest value, energy, nodes and their Fiedler entries."""
    rows = _own_rows(nodes, F.lit(1.0)).unionByName(both_ways(simple).withColumn("w", F.lit(1.0)))
    solve, schema = _whole(_key(nodes, "graph_id"), _key(nodes, "node"))
    return rows.groupBy("graph_id").applyInArrow(solve, schema)


# ---- larger graphs, as tables


@dataclass
class Level:
    """A weighted graph: ``nodes (graph_id, node, mass)``, ``links (graph_id, node, other, w)`` from either end."""

    nodes: DataFrame
    links: DataFrame
    into: DataFrame | None = None  # (graph_id, node, merged): where each node goes on the next level


def _coarser(level: Level, dense: int) -> Level | None:
    """The next level, or none when all graphs are small: nodes merge along links that both ends rank first, and a node
    whose best neighbour merges with another joins the two. Ties go by a hash of the link, so long chains merge everywhere at once."""
    growing = settle(_orders(level.nodes).where(F.col("order") > dense))
    if growing.isEmpty():
        return None
    # nodes without links are whole components: they merge by hash
    loners = level.nodes.join(growing, "graph_id").join(level.links.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_anti")
    loners = settle(loners.select("graph_id", "node", F.pmod(F.xxhash64("node", "mass"), F.ceil(F.col("order") / 2)).alias("bucket")))
    heads = loners.groupBy("graph_id", "bucket").agg(F.min("node").alias("merged"))
    growing = growing.select("graph_id")
    rank = F.struct("w", F.xxhash64(F.least("node", "other"), F.greatest("node", "other")).alias("h"), "other")
    best = level.links.join(growing, "graph_id").groupBy("graph_id", "node").agg(F.max(rank).alias("best"))
    best = settle(best.select("graph_id", "node", F.col("best.other").alias("pick")))
    back = best.select("graph_id", F.col("node").alias("pick"), F.col("pick").alias("back"))
    met = best.join(back, ["graph_id", "pick"])
    pairs = settle(met.where("back = node").select("graph_id", "node", F.least("node", "pick").alias("merged")))
    followers = met.where("back <> node").select("graph_id", "node", "pick")
    joined = followers.join(pairs.select("graph_id", F.col("node").alias("pick"), "merged"), ["graph_id", "pick"])
    moved = pairs.unionByName(joined.select("graph_id", "node", "merged"))
    moved = moved.unionByName(loners.join(heads, ["graph_id", "bucket"]).select("graph_id", "node", "merged"))
    level.into = settle(
        level.nodes.select("graph_id", "node").join(moved, ["graph_id", "node"], "left")
        .select("graph_id", "node", F.coalesce("merged", "node").alias("merged"))
    )
    into = level.into
    nodes = level.nodes.join(into, ["graph_id", "node"]).groupBy("graph_id", F.col("merged").alias("node")).agg(F.sum("mass").alias("mass"))
    far = into.select("graph_id", F.col("node").alias("other"), F.col("merged").alias("far"))
    ends = level.links.join(into, ["graph_id", "node"]).join(far, ["graph_id", "other"]).where("merged <> far")
    links = ends.groupBy("graph_id", F.col("merged").alias("node"), F.col("far").alias("other")).agg(F.sum("w").alias("w"))
    return Level(settle(nodes), settle(links))


def _names(count: int) -> list[str]:
    return [f"x{i}" for i in range(count)]


def _lowest_of_coarse(level: Level, width: int) -> DataFrame:
    """Lowest vectors of every (small) graph of the last level; hashed vectors fill up what a tiny graph lacks."""

    def solve(group: pa.Table) -> pa.Table:
        names, w, mass = _gathered(group)
        root = np.sqrt(mass)
        _, vectors = np.linalg.eigh((np.diag(w.sum(axis=1)) - w) / np.outer(root, root))
        block = np.zeros((len(names), width))
        low = (vectors / root[:, None])[:, :width]
        block[:, : low.shape[1]] = low
        columns = {"graph_id": pa.chunked_array([group["graph_id"][:1].combine_chunks().take(pa.array([0] * len(names)))])}
        columns["node"] = pa.array(names.tolist(), group["node"].type)
        return pa.table(columns | {n: block[:, i] for i, n in enumerate(_names(width))})

    rows = _own_rows(level.nodes, F.col("mass")).unionByName(level.links.select("graph_id", "node", "other", "w"))
    kinds = f"graph_id {_key(level.nodes, 'graph_id')}, node {_key(level.nodes, 'node')}"
    return rows.groupBy("graph_id").applyInArrow(solve, kinds + "".join(f", {n} double" for n in _names(width)))


@dataclass
class Matrix:
    """Cells ``(graph_id, row, node, q, own)`` of a matrix per graph and ``bounds (graph_id, c)`` above its spectrum.

    Cells of a node are split into ``part``s, so a hub's are dealt over many tasks.
    """

    cells: DataFrame
    bounds: DataFrame
    split: bool

    def product(self, state: DataFrame, *sums: Column) -> DataFrame:
        """Sums over the cells of every row, each joined with the state of its node: one join, one combinable grouping."""
        keys = ["graph_id", "node"]
        if self.split:
            parts = self.cells.where("own = 1").select(*keys, "parts")
            state = state.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            keys = [*keys, "part"]
        return self.cells.join(state, keys).groupBy("graph_id", F.col("row").alias("node")).agg(*sums)


def _matrix(own: DataFrame, links: DataFrame, bounds: DataFrame) -> Matrix:
    """From a node's own cell ``(graph_id, node, q)`` and the others ``(graph_id, row, node, q)``."""
    others = links.select("graph_id", "row", "node", "q", F.lit(0.0).alias("own"))
    diagonal = own.select("graph_id", F.col("node").alias("row"), "node", "q", F.lit(1.0).alias("own"))
    cells = diagonal.unionByName(others)
    count = cells.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("_n"))
    hubs = count.where(F.col("_n") > HUB_CELLS)
    split = not hubs.isEmpty()
    if split:
        parts = count.select("graph_id", "node", F.ceil(F.col("_n") / HUB_CELLS).cast("int").alias("parts"))
        cells = join_many_to_one(
            cells.withColumn("_k", F.struct("graph_id", "node")), parts.select(F.struct("graph_id", "node").alias("_k"), "parts"), "_k", ["row"]
        ).drop("_k")
        part = F.when(F.col("own") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        cells = cells.withColumn("part", part).repartition("graph_id", "node", "part")
    else:
        cells = cells.repartition("graph_id", "node")
    return Matrix(settle(cells), settle(bounds), split)


def _laplacian(level: Level, flipped: bool = False) -> Matrix:
    """``M^-1 L`` of a level, or ``c - L`` where the high end is wanted."""
    keys = ["graph_id", "node"]
    weight = level.links.groupBy(*keys).agg(F.sum("w").alias("d"))
    own = settle(level.nodes.join(weight, keys, "left").na.fill(0.0, ["d"]).withColumn("q", F.col("d") / F.col("mass")))
    bounds = own.groupBy("graph_id").agg(F.greatest(2 * F.max("q"), F.lit(1e-9)).alias("c"))
    links = level.links.join(own.select(*keys, "mass"), keys)
    others = links.select("graph_id", F.col("node").alias("row"), F.col("other").alias("node"), (-F.col("w") / F.col("mass")).alias("q"))
    if not flipped:
        return _matrix(own, others, bounds)
    own = join_many_to_one(own, bounds, "graph_id", ["node"]).withColumn("q", F.col("c") - F.col("q"))
    return _matrix(own, others.withColumn("q", -F.col("q")), bounds)


def _filtered(matrix: Matrix, state: DataFrame, names: Sequence[str]) -> DataFrame:
    """The block after the Chebyshev polynomial that is small on [cut, c]; ``state`` has ``cut`` and ``c`` beside the block.

    The polynomial is linear in the block, so a step is one sum over cells: a node's own cell brings the two earlier blocks along.
    """
    wide = F.col("c") - F.col("cut")
    state = state.select(
        "graph_id", "node", *names, (4 / wide).alias("s1"), (2 * (F.col("c") + F.col("cut")) / wide).alias("s0")
    )
    for step in range(DEGREE):
        cell = F.col("s1") * F.col("q") - F.col("s0") * F.col("own")
        if step == 0:
            new = [F.sum(cell / 2 * F.col(x)).alias(x) for x in names]
        else:
            new = [F.sum(cell * F.col(x) - F.col("own") * F.col(f"p{x}")).alias(x) for x in names]
        old = [F.sum(F.col("own") * F.col(x)).alias(f"p{x}") for x in names]
        kept = [F.max(F.when(F.col("own") == 1, F.col(s))).alias(s) for s in ("s1", "s0")]
        state = matrix.product(state, *new, *(old if step < DEGREE - 1 else []), *kept)
        if (step + 1) % SETTLED == 0:
            state = settle(state)
    return state.select("graph_id", "node", *names)


def _inner_products(names: Sequence[str]):
    """(graph_id, place, value): parts of Z' M Z for Z = block and its image, row by row."""
    columns = [*names, *[f"y{x}" for x in names]]
    places = np.arange(len(columns) ** 2, dtype=np.int32)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in columns], axis=1)
            weighted = z * batch["mass"].to_numpy(zero_copy_only=False)[:, None]
            codes = batch["graph_id"].dictionary_encode()
            at = codes.indices.to_numpy(zero_copy_only=False)
            for g in range(len(codes.dictionary)):
                rows = at == g
                gram = weighted[rows].T @ z[rows]
                ids = codes.dictionary.take(pa.array([g] * len(places)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(places), pa.array(gram.ravel())], ["graph_id", "place", "value"])

    return parts


def _ritz(width: int, wanted: int):
    """Rayleigh-Ritz per graph from the summed inner products."""

    def one(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h, k = gram[:width, :width], gram[:width, width:], gram[width:, width:]
        h = (h + h.T) / 2
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        lengths, axes = np.linalg.eigh(g / np.outer(scale, scale))
        strong = lengths > 1e-10 * lengths[-1]
        basis = (axes[:, strong] / np.sqrt(lengths[strong])) / scale[:, None]
        values, turned = np.linalg.eigh(basis.T @ h @ basis)
        mix = basis @ turned
        off = np.einsum("ij,ij->j", mix, k @ mix) - 2 * values * np.einsum("ij,ij->j", mix, h @ mix) + values**2
        return values, np.sqrt(np.maximum(off, 0.0)), mix

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cells, c in zip(batch["gram"].to_pylist(), batch["c"].to_pylist(), strict=True):
                values, residuals, mix = one(np.array(cells).reshape(2 * width, 2 * width))
                last = values[-1]
                gaps = np.maximum(last - values, 1e-300)
                errors = np.minimum(residuals, residuals**2 / gaps)
                full = np.zeros((width, width))
                full[:, : mix.shape[1]] = mix
                worst = errors[:wanted].max() if len(values) > wanted else np.inf
                rows.append((values[:wanted].tolist(), errors[:wanted].tolist(), full.ravel().tolist(), float(last), bool(worst <= TOLERANCE * c)))
            values, errors, mixes, lasts, done = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (values, errors, mixes)]
            arrays = [batch["graph_id"], batch["c"], *lists, pa.array(list(lasts), pa.float64()), pa.array(list(done), pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["graph_id", "c", "values", "errors", "mix", "last", "done"])

    return solve


def _rotated(names: Sequence[str], degree: int):
    """The block turned to its Ritz vectors, with the bounds of the next filter; columns without a vector are drawn anew."""
    width = len(names)

    def turn(state: pa.Table, pairs: pa.Table) -> pa.Table:
        block = np.stack([state[n].to_numpy(zero_copy_only=False) for n in names], axis=1)
        mix = np.array(pairs["mix"][0].as_py()).reshape(width, width)
        c, last = pairs["c"][0].as_py(), pairs["last"][0].as_py()
        block = block @ mix
        empty = ~mix.any(axis=0)
        drawn = np.stack([state["seed"].to_numpy(zero_copy_only=False) * (i + 1) * 0.6180339887 for i in range(width)], axis=1)
        block[:, empty] = (drawn % 1.0 - 0.5)[:, empty]
        # the filter can tell values apart that lie well below this share of the spectrum
        cut = min(0.5 * c, max(1.05 * last, c * (2.0 / degree) ** 2))
        n = state.num_rows
        columns = {"graph_id": state["graph_id"], "node": state["node"]} | {x: block[:, i] for i, x in enumerate(names)}
        return pa.table(columns | {"c": np.full(n, c), "cut": np.full(n, cut)})

    return turn


def _refined(matrix: Matrix, nodes: DataFrame, start: DataFrame, names: Sequence[str], wanted: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(Ritz pairs per graph, block) after so many rounds, fewer when all wanted values are settled before."""
    width, keys = len(names), ["graph_id", "node"]
    sizes = _orders(nodes).select("graph_id", F.ceil(F.col("order") / SLICE_NODES).cast("int").alias("slices"))
    placed = settle(
        join_many_to_one(nodes, sizes, "graph_id", ["node"])
        .withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        .withColumn("seed", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_003)).cast("double"))
        .drop("slices")
    )
    kinds = f"graph_id {_key(nodes, 'graph_id')}, node {_key(nodes, 'node')}"
    numbers = "".join(f", {n} double" for n in names)
    gid, block = f"graph_id {_key(nodes, 'graph_id')}", start
    for turn in range(rounds + 1):
        if turn:
            block = _filtered(matrix, block, names)
        images = [F.sum(F.col("q") * F.col(x)).alias(f"y{x}") for x in names]
        own = [F.sum(F.col("own") * F.col(x)).alias(x) for x in names]
        full = settle(matrix.product(block.select(*keys, *names), *own, *images).join(placed, keys))
        sums = full.select("graph_id", "mass", *names, *[f"y{x}" for x in names])
        sums = sums.mapInArrow(_inner_products(names), f"{gid}, place int, value double").groupBy("graph_id", "place").agg(F.sum("value").alias("value"))
        grams = sums.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("g"))
        grams = grams.select("graph_id", F.col("g.value").alias("gram")).join(matrix.bounds, "graph_id")
        schema = f"{gid}, c double, values array<double>, errors array<double>, mix array<double>, last double, done boolean"
        pairs = settle(grams.mapInArrow(_ritz(width, wanted), schema))
        dealt = pairs.join(sizes, "graph_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        turned = full.select(*keys, "slice", "seed", *names).groupBy("graph_id", "slice").cogroup(
            dealt.select("graph_id", "slice", "mix", "c", "last").groupBy("graph_id", "slice")
        )
        block = settle(turned.applyInArrow(_rotated(names, DEGREE), f"{kinds}{numbers}, c double, cut double"))
        if turn and pairs.where("not done").isEmpty():
            break
    return pairs, block


def _hashed_start(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    columns = [(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 - 0.5).alias(n) for i, n in enumerate(names)]
    return nodes.select("graph_id", "node", *columns)


def _low_end(simple: DataFrame, nodes: DataFrame, wanted: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """(graph_id, values, errors) and the block of lowest vectors of large graphs."""
    names = _names(wanted + GUARD)
    finest = Level(settle(nodes.withColumn("mass", F.lit(1.0))), settle(both_ways(simple).withColumn("w", F.lit(1.0))))
    levels = [finest]
    while (after := _coarser(levels[-1], dense)) is not None:
        levels.append(after)
    block = settle(_lowest_of_coarse(levels[-1], len(names)))
    for level in reversed(levels[:-1]):
        handed = level.into.join(block.withColumnRenamed("node", "merged"), ["graph_id", "merged"]).select("graph_id", "node", *names)
        rounds = ROUNDS if level is finest else COARSE_ROUNDS
        pairs, block = _refined(_laplacian(level), level.nodes, handed, names, wanted, rounds)
    return pairs.select("graph_id", "values", "errors"), block


def _high_end(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, lambda_max, residual_max) of large graphs."""
    level = Level(settle(nodes.withColumn("mass", F.lit(1.0))), settle(both_ways(simple).withColumn("w", F.lit(1.0))))
    names = _names(GUARD + 2)
    pairs, _ = _refined(_laplacian(level, flipped=True), level.nodes, _hashed_start(level.nodes, names), names, 1, ROUNDS)
    first = F.get("values", F.lit(0))
    return pairs.select("graph_id", (F.col("c") - first).alias("lambda_max"), F.get("errors", F.lit(0)).alias("residual_max"))


@dataclass
class Parts:
    """Graphs that one task solves, and those that stay tables (none where all are small)."""

    small: DataFrame
    simple: DataFrame | None
    nodes: DataFrame | None


def parted(simple: DataFrame, nodes: DataFrame, dense: int = DENSE) -> Parts:
    simple, nodes = _usable(simple, nodes)
    large = settle(_orders(nodes).where(F.col("order") > dense).select("graph_id"))
    if large.isEmpty():
        return Parts(solved_whole(simple, nodes), None, None)
    small = solved_whole(simple.join(large, "graph_id", "left_anti"), nodes.join(large, "graph_id", "left_anti"))
    return Parts(small, settle(simple.join(large, "graph_id")), settle(nodes.join(large, "graph_id")))


def low_spectrum(simple: DataFrame, nodes: DataFrame, wanted: int = KEPT_EIGENVALUES, dense: int = DENSE) -> DataFrame:
    """(graph_id, rank, value, error): the ``wanted`` smallest Laplacian eigenvalues of every graph, ascending from rank 1."""
    parts = parted(simple, nodes, dense)
    none = F.array_repeat(F.lit(0.0), F.size("values"))
    found = parts.small.select("graph_id", F.slice("values", 1, wanted).alias("values")).withColumn("errors", none)
    if parts.nodes is not None:
        found = found.unionByName(_low_end(parts.simple, parts.nodes, wanted, dense)[0])
    each = found.select("graph_id", F.posexplode(F.arrays_zip("values", "errors")).alias("at", "pair"))
    value = F.greatest(F.col("pair.values"), F.lit(0.0))
    return each.select("graph_id", (F.col("at") + 1).alias("rank"), value.alias("value"), F.col("pair.errors").alias("error"))


def fiedler_vectors(simple: DataFrame, nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(graph_id, node, value): the second eigenvector of every graph of two nodes or more, of length 1.

    The first node (by name) with an entry of some weight has a positive one. Where the second eigenvalue is repeated, it is one
    vector of many.
    """
    parts = parted(simple, nodes, dense)
    zipped = F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("fiedler").alias("value"))).alias("e")
    entries = parts.small.where(F.size("fiedler") > 0).select("graph_id", zipped).select("graph_id", "e.node", "e.value")
    if parts.nodes is None:
        return entries
    _, block = _low_end(parts.simple, parts.nodes, 2, dense)
    second = block.select("graph_id", "node", F.col("x1").alias("value"))
    scale = second.groupBy("graph_id").agg(F.max(F.abs("value")).alias("top"))
    heavy = join_many_to_one(second, scale, "graph_id", ["node"]).where(F.abs("value") > 1e-6 * F.col("top"))
    sign = heavy.groupBy("graph_id").agg(F.signum(F.min_by("value", "node")).alias("sign"))
    turned = join_many_to_one(second, sign, "graph_id", ["node"]).select("graph_id", "node", (F.col("value") * F.col("sign")).alias("value"))
    return entries.unionByName(turned)


def extremes(simple: DataFrame, nodes: DataFrame, counts: DataFrame | None = None, dense: int = DENSE) -> DataFrame:
    """(graph_id, order, lambda_2, residual_2, lambda_max, residual_max) of every graph.

    ``counts (graph_id, components)``, where given, tells which large graphs are split: their ``lambda_2`` is 0.
    """
    parts = parted(simple, nodes, dense)
    second = F.coalesce(F.get("values", F.lit(1)), F.lit(0.0))
    none = F.lit(0.0)
    found = parts.small.select(
        "graph_id", "order", second.alias("lambda_2"), none.alias("residual_2"), "lambda_max", none.alias("residual_max")
    )
    if parts.nodes is None:
        return found
    low, _ = _low_end(parts.simple, parts.nodes, 2, dense)
    if counts is None:
        counts = component_counts(components(parts.simple, parts.nodes))
    whole = F.col("components") == 1
    ends = low.join(_high_end(parts.simple, parts.nodes), "graph_id").join(_orders(parts.nodes), "graph_id").join(counts, "graph_id")
    large = ends.select(
        "graph_id",
        "order",
        F.when(whole, F.get("values", F.lit(1))).otherwise(none).alias("lambda_2"),
        F.when(whole, F.get("errors", F.lit(1))).otherwise(none).alias("residual_2"),
        "lambda_max",
        "residual_max",
    )
    return found.unionByName(large)


def energies(simple: DataFrame, nodes: DataFrame, dense: int = DENSE, moments: int = MOMENTS) -> DataFrame:
    """(graph_id, order, energy, error): the sum of the absolute adjacency eigenvalues.

    Exact for graphs that one task solves. For larger ones ``|t|`` is expanded in Chebyshev polynomials up to twice
    ``moments`` and its trace taken from ``PROBES`` sign vectors; ``error`` is three standard errors plus the rest of the series.
    """
    parts = parted(simple, nodes, dense)
    found = parts.small.select("graph_id", "order", "energy", F.lit(0.0).alias("error"))
    if parts.nodes is None:
        return found
    degree = settle(degrees(parts.simple, parts.nodes))
    ends = parts.simple.join(degree.select("graph_id", F.col("node").alias("src"), F.col("degree").alias("a")), ["graph_id", "src"])
    ends = ends.join(degree.select("graph_id", F.col("node").alias("dst"), F.col("degree").alias("b")), ["graph_id", "dst"])
    # no adjacency eigenvalue is above the largest geometric mean of the degrees of two neighbours
    reach = ends.groupBy("graph_id").agg(F.sqrt(F.max(F.col("a") * F.col("b"))).alias("c"))
    bounds = _orders(parts.nodes).join(reach, "graph_id", "left").na.fill(1.0, ["c"])
    own = parts.nodes.withColumn("q", F.lit(0.0))
    links = both_ways(parts.simple).select("graph_id", F.col("node").alias("row"), F.col("other").alias("node"), F.lit(1.0).alias("q"))
    matrix = _matrix(own, links, bounds)
    names = _names(PROBES)
    signs = [(2.0 * F.pmod(F.xxhash64("node", F.lit(i + 101)), F.lit(2)) - 1).alias(n) for i, n in enumerate(names)]
    state = join_many_to_one(parts.nodes, bounds.select("graph_id", "c"), "graph_id", ["node"]).select("graph_id", "node", "c", *signs)
    state = settle(state)
    squares = [state.groupBy("graph_id").agg(F.lit(0).alias("step"), *[F.sum(F.col(n) * F.col(n)).alias(n) for n in names])]
    for step in range(1, moments + 1):
        cell = F.col("q") / F.col("c")
        if step == 1:
            new = [F.sum(cell * F.col(x)).alias(x) for x in names]
        else:
            new = [F.sum(2 * cell * F.col(x) - F.col("own") * F.col(f"p{x}")).alias(x) for x in names]
        old = [F.sum(F.col("own") * F.col(x)).alias(f"p{x}") for x in names]
        state = settle(matrix.product(state, *new, *old, F.max(F.when(F.col("own") == 1, F.col("c"))).alias("c")))
        squares.append(state.groupBy("graph_id").agg(F.lit(step).alias("step"), *[F.sum(F.col(n) * F.col(n)).alias(n) for n in names]))
    table = squares[0]
    for one in squares[1:]:
        table = table.unionByName(one)
    # <T_j z, T_j z> = (moment of 2 j + moment of 0) / 2
    j = F.col("step")
    share = F.when(j == 0, F.lit(2 / np.pi)).otherwise(4 / np.pi * F.when(j % 2 == 1, 1.0).otherwise(-1.0) / (4 * j * j - 1))
    rows = table.join(bounds, "graph_id")
    traces = [F.sum(share * F.when(j == 0, F.col(n)).otherwise(2 * F.col(n) - F.col("order"))).alias(n) for n in names]
    summed = rows.groupBy("graph_id", "order", "c").agg(*traces)
    spread = F.array(*[F.col("c") * F.col(n) for n in names])
    rest = F.col("c") * F.col("order") * (2 / np.pi) / (2 * moments + 1)
    mean = F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / PROBES
    scored = summed.select("graph_id", "order", spread.alias("t"), rest.alias("rest")).withColumn("energy", mean)
    deviation = F.aggregate("t", F.lit(0.0), lambda s, x: s + (x - F.col("energy")) ** 2) / (PROBES - 1) / PROBES
    return found.unionByName(scored.select("graph_id", "order", "energy", (3 * F.sqrt(deviation) + F.col("rest")).alias("error")))


FEATURES = (
    "order", "size", "lambda_2", "density", "mean_degree", "max_degree", "degree_variance", "leaves",
    "trace_l", "trace_l2", "cyclomatic", "energy_bound", "lambda_max", "components",
)


def feature_vectors(descriptors: DataFrame, spectra: DataFrame, component_counts: DataFrame) -> DataFrame:
    """The 14 features per graph as one vector."""
    joined = descriptors.join(spectra.select("graph_id", "lambda_2", "lambda_max"), "graph_id")
    joined = joined.join(component_counts, "graph_id")
    vector = F.array(*[F.col(f).cast("double") for f in FEATURES])
    return joined.select("graph_id", vector.alias("raw_feature_vector"))
