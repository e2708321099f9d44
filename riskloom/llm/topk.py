"""Exact top-k by integer inner product, over a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it; a pivot's distances are cut into annuli of about equal
numbers. For a query q, pivot p and annulus of distances [lo, hi], the triangle inequality bounds the distance of q to every
vector x in it from below by the gap between |q - p| and [lo, hi], so x.q = (|q|^2 + |x|^2 - |q - x|^2) / 2 is bounded from
above; x.q <= p.q + |q| hi is a second bound. A query first visits its most promising annulus, then some more in rounds, then
every annulus whose bound still reaches its k-th best score, and stops. The annuli of a round are written down with the query.

Neighbouring annuli lie in one slab; queries go to slabs in lots, each with marks for the annuli it visits, and a lot leaves a
slab with the k best of each query. Slabs are as many as keep tasks busy and else as large as a row may be, as every query is
sent once to each slab that it visits. Lots are far more than the table of queries they are made of, by whose size the
planner would judge them: they are joined by merging, never broadcast.

Components are floor(64 x) of each value x, taken as double, in the narrowest integers that hold them all. Equal vectors are held
once, with the smallest ``k + 1`` of their ids: no other id can be among the k best, as ties go to smaller ids and a query
leaves out only its own.

The driver holds a sample of ``SAMPLE`` vectors for the pivots and a few numbers per annulus, at most ``MAX_PIVOTS * MAX_RINGS``.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; equal
rows count once; vectors of different length are compared as if padded with zeros; fewer than k candidates give all of
them; an empty table gives no rows. Other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

SAMPLE, MAX_PIVOTS, MAX_RINGS, CHUNK = 4096, 128, 32, 1024
FIRST_ROUNDS, REST = (1, 6, 48, 384), 10  # annuli of the rounds before the last, which takes up to so many times those visited
SLABS, SLAB_BYTES, LOT = 64, 1 << 22, 2048  # least number of slabs, most bytes of one, queries that go to it together
CHOICE, TILE_WIDTH, TILE = 256, 256, 1 << 19  # queries whose annuli are chosen at once, least columns and usual size of scores made at once
LEAST = -(1 << 62)


def usable(embedding: Column) -> Column:
    """Whether a vector has components and all of them are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite)


def _kind(low: float, high: float) -> str:
    """The narrowest integers that hold the components of values from ``low`` to ``high``."""
    fits = (f"<i{n}" for n in (1, 2, 4) if np.floor(64 * low) >= -(1 << 8 * n - 1) and np.floor(64 * high) < 1 << 8 * n - 1)
    return next(fits, "<i8")


def _quantise(dim: int, kind: str):
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["embedding"]
            values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            whole = np.zeros((len(sizes), dim), kind)
            row = np.repeat(np.arange(len(sizes)), sizes)
            whole[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(64 * values.astype(float))
            codes = pa.array([x.tobytes() for x in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], codes], ["vec_id", "code"])

    return quantise


def _matrix(codes: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes), kind).reshape(len(codes), dim)


def _widened(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which inner products of their rows are exact; in floating point where possible."""
    most = [max(1, abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (left, right)]
    top = most[0] * most[1] * left.shape[1]
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return left.astype(kind), right.astype(kind)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means from evenly spread sample rows."""
    rows = sample.astype(float)
    pivots = rows[np.linspace(0, len(rows) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = _distances(rows, pivots).argmin(axis=1)
        for i in range(count):
            if (nearest == i).any():
                pivots[i] = rows[nearest == i].mean(axis=0)
    return pivots


@dataclass(frozen=True)
class Rings:
    """Annuli of the index: their pivot, distance range, largest squared norm and slab, which has them side by side."""

    pivots: np.ndarray
    ring: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    slab: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with anything in each annulus."""
        q = queries.astype(float)
        to_pivot = _distances(q, self.pivots)[:, self.pivot]
        squared = (q**2).sum(axis=1)[:, None]
        gap = np.maximum(0, np.maximum(self.low - to_pivot, to_pivot - self.high) - 1e-6 * (1 + self.high))
        by_gap = (squared + self.norm - gap**2) / 2
        by_reach = (q @ self.pivots.T)[:, self.pivot] + np.sqrt(squared) * self.high
        bound = np.minimum(by_gap, by_reach)
        return bound + 0.5 + 1e-9 * np.abs(bound)


def _keyed(pivots: np.ndarray, dim: int, kind: str):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch["code"].to_pylist(), dim, kind)
            distances = _distances(rows, pivots)
            nearest = distances.argmin(axis=1)
            new = [
                pa.array(nearest, pa.int32()),
                pa.array(distances[np.arange(len(rows)), nearest]),
                pa.array((rows.astype(float) ** 2).sum(axis=1)),
            ]
            yield pa.RecordBatch.from_arrays([batch["code"], batch["ids"], *new], ["code", "ids", "pivot", "distance", "norm"])

    return key


def _slab_of(counts: np.ndarray, most: int) -> np.ndarray:
    """The slab of each annulus: neighbours with ``most`` vectors together, or one annulus that has more."""
    slabs, slab, held = [], 0, 0
    for count in counts.tolist():
        if held and held + count > most:
            slab, held = slab + 1, 0
        held += count
        slabs.append(slab)
    return np.array(slabs, np.int32)


def _slabs(most: int):
    """Pack rows that stand side by side and share a slab, up to ``most``; vectors of an annulus are a run in it."""

    def flush(slab: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        place, ids = rows["place"].to_numpy(), rows["ids"].combine_chunks()
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        values = [slab, place[cuts], np.diff(cuts, append=len(place)), b"".join(rows["code"].to_pylist())]
        values += [ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())]
        ints = pa.list_(pa.int32())
        kinds = [pa.int32(), ints, ints, pa.binary(), pa.list_(pa.int64()), ints]
        columns = [pa.array([v], t) for v, t in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slab", "places", "runs", "codes", "ids", "sizes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many = -1, [], 0
        for batch in batches:
            slab = batch["slab"].to_numpy()
            at = 0
            while at < len(slab):
                if held and (slab[at] != own or many == most):
                    yield flush(own, held)
                    held, many = [], 0
                own = int(slab[at])
                end = min(np.searchsorted(slab, own, "right"), at + most - many)
                held.append(batch.slice(at, end - at))
                many += end - at
                at = end
        if held:
            yield flush(own, held)

    return pack


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _choose(rings: Rings, dim: int, kind: str, take: int | None):
    """Annuli that each query visits now: the ``take`` most promising of those it has not seen, as far as they can matter."""
    many = len(rings.ring)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHOICE):
                part = batch.slice(a, CHOICE)
                queries = _matrix(part["code"].to_pylist(), dim, kind)
                least = part["least"].fill_null(LEAST).to_numpy(zero_copy_only=False)
                seen = part["seen"].fill_null(bytes((many + 7) // 8)).to_pylist()
                seen = np.unpackbits(_matrix(seen, (many + 7) // 8, "u1"), axis=1, count=many).astype(bool)
                bounds = rings.bounds(queries)
                now = ~seen & (bounds >= least[:, None])
                if take is not None and take < many:
                    best = np.argpartition(np.where(now, -bounds, np.inf), take - 1, axis=1)[:, :take]
                    few = np.zeros_like(now)
                    np.put_along_axis(few, best, True, axis=1)
                    now &= few
                marks = [_binary(np.packbits(x, axis=1)) for x in (seen | now, now)]
                columns = [part["query_id"], part["code"], part["least"], *marks]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "code", "least", "seen", "now"])

    return choose


def _lots(rings: Rings, dim: int, kind: str):
    """Lots of queries per slab, with a mark for each annulus of the slab that a query visits."""
    firsts = np.flatnonzero(np.diff(rings.slab, prepend=-1))
    ends = [*firsts[1:], len(rings.slab)]
    ints = pa.list_(pa.int64())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, LOT):
                part = batch.slice(a, LOT)
                queries = _matrix(part["code"].to_pylist(), dim, kind)
                names = part["query_id"].to_numpy(zero_copy_only=False)
                least = part["least"].fill_null(LEAST).to_numpy(zero_copy_only=False)
                now = np.unpackbits(_matrix(part["now"].to_pylist(), (len(rings.slab) + 7) // 8, "u1"), axis=1)
                for slab, (first, end) in enumerate(zip(firsts, ends, strict=True)):
                    marks = now[:, first:end]
                    own = marks.any(axis=1)
                    if own.any():
                        row = [slab, names[own], queries[own].tobytes(), least[own], np.packbits(marks[own], axis=1).tobytes()]
                        columns = [pa.array([v], t) for v, t in zip(row, [pa.int32(), ints, pa.binary(), ints, pa.binary()], strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["slab", "names", "queries", "least", "marks"])

    return deal


def _ranked(query: np.ndarray, score: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by query, falling score and name, and the place of each in its query."""
    order = np.lexsort((name, -score, query))
    at, own = np.arange(len(order)), query[order]
    first = np.ones(len(order), bool)
    first[1:] = own[1:] != own[:-1]
    return order, at - np.maximum.accumulate(np.where(first, at, 0))


def _search(queries, rows, places, runs, marks, least, names, many) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the ``many`` best rows of each query in the runs it visits, smaller names first among equals.

    ``least`` is the score from which on a row counts; it rises with what is found.
    """
    queries, rows = _widened(queries, rows)
    least, held, fresh, end = least.copy(), [np.zeros((3, 0), np.int64)], 0, 0

    def settled() -> np.ndarray:
        q, x, score = found = np.concatenate(held, axis=1)
        order, place = _ranked(q, score, names[x])
        last = order[place == many - 1]
        least[q[last]] = np.maximum(least[q[last]], score[last])
        return found[:, order[place < many]]

    for place, run in zip(places, runs, strict=True):
        begin, end = end, end + run
        own = np.flatnonzero(marks[:, place])
        left, wide = queries[own], max(TILE_WIDTH, TILE // max(1, len(own)))
        for a in range(begin, end if len(own) else begin, wide):
            scores = left @ rows[a : min(a + wide, end)].T
            floor = least[own].astype(scores.dtype)
            some = np.flatnonzero(scores.max(axis=1) >= floor)
            if not len(some):
                continue
            scores, floor = scores[some], floor[some][:, None]
            hits = scores >= floor
            if np.count_nonzero(hits) > 4 * many * len(some) and scores.shape[1] > many:
                hits = scores >= np.maximum(floor, np.partition(scores, -many, axis=1)[:, [-many]])
            q, x = np.nonzero(hits)
            held.append(np.stack([own[some[q]], a + x, scores[q, x].astype(np.int64)]))
            fresh += len(q)
            if fresh > 8 * many * len(queries):
                held, fresh = [settled()], 0
    return tuple(settled())


def _score(dim: int, kind: str, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, least, places, runs, ids, sizes = (
                    batch[c][i].values.to_numpy() for c in ("names", "least", "places", "runs", "ids", "sizes")
                )
                queries, rows = (np.frombuffer(batch[c][i].as_buffer(), kind).reshape(-1, dim) for c in ("queries", "codes"))
                marks = np.unpackbits(np.frombuffer(batch["marks"][i].as_buffer(), "u1").reshape(len(names), -1), axis=1)
                starts = np.cumsum(sizes, dtype=np.int64) - sizes
                # one of the k + 1 best vectors may be the query itself
                q, x, scores = _search(queries, rows, places, runs, marks, least, ids[starts], k + 1)
                many = sizes[x]
                at = np.repeat(starts[x] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                query, found, scores = np.repeat(names[q], many), ids[at], np.repeat(scores, many)
                other = query != found
                query, found, scores = query[other], found[other], scores[other]
                order, place = _ranked(query, scores, found)
                best = order[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[best], pa.int64()) for v in (query, found, scores)], ["query_id", "vec_id", "score"]
                )

    return score


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(rings: int) -> Iterator[int | None]:
    """Annuli that a query visits in each round, None for all that are left."""
    done = 0
    for take in FIRST_ROUNDS:
        if rings - done > REST * done:
            done += take
            yield take
    if done < rings:
        yield None


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for every row of ``(vec_id, embedding)`` that ``is_query`` picks."""
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    usable_rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    extent = (F.min(F.array_min("embedding")), F.max(F.array_max("embedding")))
    dim, *extent = usable_rows.agg(F.max(F.size("embedding")), *extent).first()
    if dim is None:
        return spark.createDataFrame([], result)
    kind = _kind(*extent)
    codes = usable_rows.mapInArrow(_quantise(dim, kind), "vec_id bigint, code binary").dropDuplicates()
    codes = stored(codes, "codes")
    smallest = codes.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    entries = stored(smallest.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    count = entries.count()
    pivots_wanted = int(min(MAX_PIVOTS, max(1, np.sqrt(count / CHUNK) * 2)))
    rings_wanted = int(min(MAX_RINGS, max(1, count // (CHUNK * pivots_wanted))))
    sample = entries.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).select("code").toArrow()["code"].to_pylist()
    pivots = choose_pivots(_matrix(sample, dim, kind), min(pivots_wanted, len(sample)))

    ddl = "code binary, ids array<bigint>, pivot int, distance double, norm double"
    keyed = stored(entries.mapInArrow(_keyed(pivots, dim, kind), ddl), "keyed")
    cuts = [(i + 1) / rings_wanted for i in range(rings_wanted - 1)]
    edges = keyed.groupBy("pivot").agg(F.percentile_approx("distance", cuts or [0.5], 1000).alias("edges"))
    inner = F.filter("edges", lambda e: e < F.col("distance")) if cuts else F.array()
    ringed = keyed.join(F.broadcast(edges), "pivot").select(
        "code", "ids", "pivot", "distance", "norm", (F.col("pivot") * rings_wanted + F.size(inner)).cast("int").alias("ring")
    )
    ringed = stored(ringed, "ringed")
    facts = ringed.groupBy("ring", "pivot").agg(
        F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("many")
    )
    facts = facts.orderBy("ring").toArrow()
    most = max(CHUNK, min(count // SLABS, SLAB_BYTES // (dim * np.dtype(kind).itemsize)))
    slab = _slab_of(facts["many"].to_numpy(), most)
    rings = Rings(pivots, *(facts[c].to_numpy() for c in ("ring", "pivot", "low", "high", "norm")), slab)

    place = (np.arange(len(slab)) - np.searchsorted(slab, slab)).astype(np.int32)
    parts = -(-facts["many"].to_numpy() // most)  # more than one where an annulus alone is more than a slab holds
    places = pa.table({"ring": rings.ring, "slab": slab, "place": place, "parts": parts})
    part = F.pmod(F.xxhash64("code"), "parts").alias("part")
    dealt = ringed.join(F.broadcast(spark.createDataFrame(places)), "ring").select("slab", part, "place", "code", "ids")
    dealt = dealt.repartition("slab", "part").sortWithinPartitions("slab", "place")
    ddl = "slab int, places array<int>, runs array<int>, codes binary, ids array<bigint>, sizes array<int>"
    slabs = stored(dealt.mapInArrow(_slabs(most), ddl), "slabs")

    queries = codes.where(is_query).select(F.col("vec_id").alias("query_id"), "code")
    queries = queries.withColumns({"least": F.lit(None).cast("bigint"), "seen": F.lit(None).cast("binary")})
    best = None
    for take in _rounds(len(rings.ring)):
        ddl = "query_id bigint, code binary, least bigint, seen binary, now binary"
        visits = stored(queries.mapInArrow(_choose(rings, dim, kind, take), ddl), "visits")
        ddl = "slab int, names array<bigint>, queries binary, least array<bigint>, marks binary"
        lots = visits.mapInArrow(_lots(rings, dim, kind), ddl).hint("merge")
        hits = lots.join(slabs, "slab").mapInArrow(_score(dim, kind, k), "query_id bigint, vec_id bigint, score bigint")
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best = stored(_best(hits, k), "best")
        # the score a further candidate must reach: that of rank k, or anything while there are fewer
        least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")).hint("merge")
        queries = visits.select("query_id", "code", "seen").join(least, "query_id", "left").select("query_id", "code", "least", "seen")
    return best.select("query_id", "rank", "vec_id", "score")
