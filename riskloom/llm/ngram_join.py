"""Jaccard join of documents on their word shingles: classes of documents connected by links.

Two documents link when their sets of distinct shingles have ``|A & B| / |A | B| >= similarity``. The join is exact and
depends on set sizes:

* light sets (below a boundary) enumerate their subsets: at most a share ``1 - similarity`` of a set can lie outside a
  partner, so two linked light sets both list their intersection among their subsets with so many members left out;
* heavy sets go through inverted lists. Single shingles would make lists as long as the most frequent passage, so a list
  stands for a bundle: sets of about one size (a zone) are cut into ranges of hash values, three more than the number of
  shingles two linked sets of that zone can differ in. Linked sets then agree in three ranges at least, and share the
  list of each; a set may leave out up to two empty ranges.

The boundary is the one of least expected cost over the histogram of small sizes. Sets of equal content are one node, found
by a 128-bit hash before the join, so copies cost nothing. Members of a list are first held against one of them, a few times
over; after those links, only lists that still join several components are searched further: short lists by pairs, long
ones block against block inside tasks. Pairs meet as parity sketches (a bit or two a member) first, which rule out most without their
sets and never a link; sets are made again from the texts for the pairs left over, and no others are stored or shuffled. No list is cut
short and no pair within a component is made.

Defined cases: null texts and texts without words have no shingles and link with nothing; fewer words than a shingle make
one shingle; rows with a null doc_id get their size and a null component; rows with equal doc_id count as one document;
an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.shingles import Shingler, mix, text_slices
from riskloom.llm.tokens import release_encoders
from riskloom.operators.graphs import components

SPARE = 2  # ranges beyond the necessary one, so that empty ones need no list
LIST_COST = 3.0  # what a list entry costs against a subset entry: lists of small sets hold strangers
LARGEST_LIGHT = 40
PAIR_LIST, BLOCK = 24, 512
MORE_STARS = 1
CELL_BITS = 20
_FACTS = "doc_id bigint, n_shingles bigint, node bigint, check bigint, sketch binary"
_SETS = "node bigint, again boolean, members binary"
_ZONE, _RANGE, _LIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Likeness:
    """A similarity of ``part / whole``."""

    part: int
    whole: int = 100

    def linked(self, shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        return self.whole * shared >= self.part * (size_a + size_b - shared)

    def outside(self, size: int) -> int:
        """Members of a set of this size that can be missing from a linked one."""
        return size * (self.whole - self.part) // self.whole

    def largest(self, size: int) -> int:
        """Size of the largest set that can link with one of this size."""
        return size * self.whole // self.part

    def differing(self, size_a: int, size_b: int) -> int:
        """Members that can be in one of two linked sets only."""
        return (size_a + size_b) * (self.whole - self.part) // (self.whole + self.part)


def subset_count(size: int, like: Likeness) -> int:
    return sum(comb(size, k) for k in range(like.outside(size) + 1))


class Zones:
    """Bands of set sizes, such that linked sets lie in the same or neighbouring ones, and the ranges of each zone."""

    def __init__(self, like: Likeness, boundary: int):
        self.like = like
        self.starts = [max(1, -(-boundary * like.part // like.whole))]  # light sets that can meet heavy ones are in, too
        self.edges: dict[int, np.ndarray] = {}

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.like.largest(self.starts[-1]) + 1)
        return bisect_right(self.starts, size) - 1

    def cuts(self, zone: int) -> np.ndarray:
        """Lower ends of the ranges of hash values of a zone."""
        if zone not in self.edges:
            top = self.starts[zone + 1] - 1
            ranges = self.like.differing(top, self.like.largest(top)) + 1 + SPARE
            self.edges[zone] = (np.arange(ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)).astype(np.uint64)
        return self.edges[zone]


def list_keys(shingles: np.ndarray, zones: Zones) -> np.ndarray:
    """Lists a heavy set is in: one per range of its own zone and the zone below."""
    band, found = zones.band(len(shingles)), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles))])
    for zone in (band, band - 1):
        if zone < 0:
            continue
        at = np.searchsorted(shingles, zones.cuts(zone))
        stops = np.append(at[1:], len(shingles))
        keys = mix((sums[stops] - sums[at]) ^ (np.arange(len(at), dtype=np.uint64) * _RANGE) ^ (np.full(len(at), zone + 1, np.uint64) * _ZONE))
        full = stops > at
        found.append(keys if len(keys) - full.sum() > SPARE else keys[full])
    return np.concatenate(found)


def subset_keys(shingles: np.ndarray, like: Likeness) -> np.ndarray:
    """Hashes of the subsets of a light set that can be its intersection with a linked one."""
    mixed = mix(shingles)
    total, keys = int(mixed.sum()), []
    members = mixed.tolist()
    for left_out in range(like.outside(len(members)) + 1):
        keys += [(total - sum(gone)) & ((1 << 64) - 1) for gone in combinations(members, left_out)]
    return mix(np.array(keys, np.uint64) ^ _LIGHT)


def _set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two signed integers."""
    first, second = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(), mix(shingles * np.uint64(0xD1342543DE82EF95)).sum()
    return int(np.int64(first.astype(np.int64))), int(second.astype(np.int64))


def _facts(size: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        shingler = Shingler(size)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch["text"]):
                rows = [(len(s), *((*_set_hashes(s), sketch(s)) if len(s) else (None, None, None))) for s in shingler.sets(data, offsets)]
                counts, node, check, sketches = zip(*rows, strict=True)
                columns = [batch["doc_id"].slice(a, b - a), *[pa.array(x, pa.int64()) for x in (counts, node, check)], pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "check", "sketch"])

    return facts


def _signatures(size: int, like: Likeness, boundary: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, zones, seen = Shingler(size), Zones(like, boundary), set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch["text"]):
                keys, nodes = [], []
                for shingles in shingler.sets(data, offsets):
                    if not len(shingles):
                        continue
                    node = _set_hashes(shingles)[0]
                    if node in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    own = [subset_keys(shingles, like)] if len(shingles) < boundary else []
                    if len(shingles) >= zones.starts[0]:
                        own.append(list_keys(shingles, zones))
                    keys += own
                    nodes += [np.full(len(x), node, np.int64) for x in own]
                if keys:
                    arrays = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "node"])

    return signatures


def _sets(size: int):
    """Sets of the texts whose content is the wanted one."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch["text"]):
                wanted, again = (batch[c].slice(a, b - a).to_pylist() for c in ("node", "again"))
                rows = [
                    (n, r, s)
                    for n, r, s in zip(wanted, again, shingler.sets(data, offsets), strict=True)
                    if len(s) and _set_hashes(s)[0] == n
                ]
                nodes, flags, found = pa.array([n for n, _, _ in rows], pa.int64()), pa.array([r for _, r, _ in rows], pa.bool_()), [s for _, _, s in rows]
                yield pa.RecordBatch.from_arrays([nodes, flags, pa.array([s.tobytes() for s in found], pa.binary())], ["node", "again", "members"])

    return sets


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the members in each of many cells: two sketches differ in at most as many bits as the sets do in members.

    There is a cell to a member at least, a power of two; a longer sketch folds to a shorter one half upon half. Strangers of a size
    differ in four tenths of their cells or more; more cells would tell apart a few pairs more, but all of them travel with every pair.
    """
    bits = max(1024, 1 << (len(shingles) - 1).bit_length())
    cells = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def apart(left: bytes, right: bytes) -> int:
    """Bits in which two sketches differ, at the length of the shorter."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _may_link(like: Likeness):
    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differences = [apart(a, b) for a, b in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)]
            sizes = batch["na"].to_numpy() + batch["nb"].to_numpy()
            mask = pa.array(np.array(differences) <= like.differing(sizes, 0))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return may_link


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum()) if len(right) else 0


def _verify(like: Likeness):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                linked.append(bool(like.linked(_shared(a, b), len(a), len(b))))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["src", "dst"])

    return verify


def _block_pairs(like: Likeness):
    """Pairs of different components in one pair of blocks whose sketches leave a link possible."""
    import pandas as pd

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        sketches = group["sketch"].tolist()
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, 16), axis=0) for x in sketches]
        bits = np.stack(folded)
        sizes, node, root, home = (group[c].to_numpy() for c in ("size", "node", "label", "home"))
        low, high, found = group["low"].iloc[0], group["high"].iloc[0], []
        for i in np.flatnonzero(home == low):
            others = np.flatnonzero((home == high) & (root != root[i]) & ((node > node[i]) | (low != high)))
            most = like.differing(sizes[others] + sizes[i], 0)
            near = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most
            hits = [j for j, m in zip(others[near], most[near], strict=True) if apart(sketches[i], sketches[j]) <= m]
            found += [(min(node[i], node[j]), max(node[i], node[j])) for j in hits]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return pairs


def choose_boundary(counts: dict[int, int], like: Likeness) -> int:
    """Size from which sets are heavy, given how many sets there are of each small size."""

    def cost(boundary: int) -> float:
        zones, total = Zones(like, boundary), 0.0
        for size, n in counts.items():
            total += n * subset_count(size, like) if size < boundary else 0
            if size >= zones.starts[0]:
                band = zones.band(size)
                total += n * LIST_COST * sum(len(zones.cuts(z)) for z in (band, band - 1) if z >= 0)
        return total

    return min(range(2, LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component label per node."""
    edges = links.select(F.lit(0).alias("graph_id"), "src", "dst")
    labelled = components(edges, nodes.select(F.lit(0).alias("graph_id"), "node"))
    return labelled.select("node", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the labels that these join, the others stay as they are."""
    one, two = (labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}")) for n in ("src", "dst"))
    ends = links.join(one, "src").join(two, "dst").where("label_src <> label_dst")
    joins = stored(ends.select(F.least("label_src", "label_dst").alias("src"), F.greatest("label_src", "label_dst").alias("dst")).distinct(), "label-links")
    if joins.isEmpty():
        return labels
    roots = _labels(joins, joins.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    return stored(moved.select("node", F.coalesce("root", "label").alias("label")), "labels")


def _wanted(sets: DataFrame, pairs: DataFrame, name: str = "node", ends: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The sets of pairs ``(a, b)``, and some more: those whose nodes fall into the same of ``2 ** CELL_BITS`` cells.

    Sets are wide and pairs may be few; the cells are bounded and go to the sets, which need not be shuffled to be left out.
    """
    cell = F.pmod(F.xxhash64(name), F.lit(1 << CELL_BITS)).alias("_cell")
    cells = pairs.select(F.explode(F.array(*ends)).alias(name)).select(cell).distinct()
    return sets.select("*", cell).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def _members(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, members) of the nodes of pairs ``(a, b)``, from the texts of ``rows``: (node, doc_id, again)."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = stored(rows.join(nodes, "node", "left_semi"), "pair-rows")
    # a document may come in several rows: only rows with the wanted content are taken
    chosen = _wanted(texts, rows, "doc_id", ("doc_id",)).join(rows, "doc_id").select("node", "again", "text")
    chosen = stored(chosen.mapInArrow(_sets(words), _SETS), "pair-sets")
    # sets are wide: only those that come again are shuffled to be merged
    merged = stored(chosen.where("again").dropDuplicates(["node"]), "repeated-sets")
    return chosen.where("not again").unionByName(merged).drop("again")


def _pairs_linked(pairs: DataFrame, sketches: DataFrame, members: Callable[[DataFrame], DataFrame], like: Likeness) -> DataFrame:
    """Links among pairs ``(a, b)``: by the sketches first, then by the sets of those that are left."""

    def side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(n) for c, n in zip(columns[::2], columns[1::2], strict=True)])

    near = pairs.join(side(sketches, "a", "sketch", "sa", "size", "na"), "a").join(side(sketches, "b", "sketch", "sb", "size", "nb"), "b")
    near = stored(near.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(_may_link(like), "a bigint, b bigint"), "near-pairs")
    sets = members(near)
    both = near.join(side(sets, "a", "members", "left"), "a").join(side(sets, "b", "members", "right"), "b")
    return both.mapInArrow(_verify(like), "src bigint, dst bigint")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the lists that still hold several components, with their labels and the list's size."""
    marked = lists.select("key", "node").join(labels, "node")
    mixed = marked.groupBy("key").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("n")
    )
    return marked.join(mixed.where("_low <> _high").select("key", "n"), "key")


def jaccard_classes(docs: DataFrame, words: int = 5, like: Likeness = Likeness(80)) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of those connected by links, itself included) per row."""
    texts = docs.select("doc_id", "text")
    facts = stored(texts.mapInArrow(_facts(words), _FACTS), "shingle-facts")
    given = facts.where("doc_id is not null and n_shingles > 0")
    classes = stored(given.groupBy("node", "check").agg(F.min("doc_id").alias("first")), "shingle-classes")
    small = given.where(F.col("n_shingles") <= 2 * LARGEST_LIGHT).groupBy("n_shingles").count().collect()
    boundary = choose_boundary({r["n_shingles"]: r["count"] for r in small}, like)

    keyed = texts.where("doc_id is not null and text is not null").mapInArrow(
        _signatures(words, like, boundary), "key bigint, node bigint"
    )
    of_key = Window.partitionBy("key")
    head, last = F.min("node").over(of_key), F.max("node").over(of_key)
    live = keyed.withColumn("head", head).withColumn("_last", last).where("head <> _last").select("key", "head", "node").distinct()
    live = stored(live, "lists")

    wanted = live.select("node").distinct()
    sketches = given.select("node", "sketch", F.col("n_shingles").alias("size")).dropDuplicates(["node"])
    sketches = stored(sketches.join(wanted, "node", "left_semi"), "sketches")
    first = wanted.join(classes, "node").select("node", F.col("first").alias("doc_id"))
    rows = given.groupBy("doc_id", "node").agg((F.count(F.lit(1)) > 1).alias("again"))
    rows = stored(first.join(rows, ["doc_id", "node"]).select("node", "doc_id", "again"), "set-rows")

    def members(pairs: DataFrame) -> DataFrame:
        return _members(pairs, rows, texts, words)

    # members against one member of their list: the least node first, then the least of a component drawn by hash
    stars = live.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    # the texts of a document that comes with several are connected
    several = given.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("_last")).where("src <> _last")
    same = given.join(several.select("doc_id", "src"), "doc_id").where("node <> src").select("src", F.col("node").alias("dst"))
    same = stored(same.distinct(), "same-documents")
    nodes = live.select("node").unionByName(same.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), "nodes")
    labels = _merged(labels, _pairs_linked(stars, sketches, members, like).unionByName(same))
    open_lists = live.select("key", "node")
    for turn in range(MORE_STARS):
        # a list of one component stays one: later turns only look at those that were open
        open_lists = stored(_open_lists(open_lists, labels), "open-lists")
        drawn = F.struct(F.xxhash64(F.lit(turn), "label").alias("h"), "label", "node")
        heads = open_lists.groupBy("key").agg(F.min(drawn).alias("_h")).select("key", F.col("_h.node").alias("a"), F.col("_h.label").alias("_l"))
        met = open_lists.join(heads, "key").where("label <> _l")
        stars = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        labels = _merged(labels, _pairs_linked(stars, sketches, members, like))

    # what lists still hold several components: every pair of different ones
    open_lists = stored(_open_lists(open_lists, labels), "open-lists")
    short = open_lists.where(F.col("n") <= PAIR_LIST)
    one, two = (short.select("key", F.col("node").alias(n), F.col("label").alias(f"label_{n}")) for n in "ab")
    pairs = one.join(two, "key").where("a < b and label_a <> label_b").select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = open_lists.where(F.col("n") > PAIR_LIST).withColumn("home", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("key", "node", "label", "home", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"))
    grouped = met.join(sketches, "node").groupBy("key", "low", "high")
    pairs = pairs.unionByName(grouped.applyInPandas(_block_pairs(like), "a bigint, b bigint")).distinct()
    labels = _merged(labels, _pairs_linked(pairs, sketches, members, like))

    named = classes.join(labels, "node", "left").select("node", "check", "first", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(named.join(smallest, "label").select("node", "check", "component_id"), "named-classes")
    found = facts.join(named, ["node", "check"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))
