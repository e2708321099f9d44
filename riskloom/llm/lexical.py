"""Ranked lexical search: the best documents for every item of a stated query set, term at a time with limited accumulators.

The collection is cut into shards of rows, as search engines cut theirs. In a shard an item's terms come rarest first. A
document met for the first time gets an accumulator only while the bounds of the terms still to come (the largest impact of
each in the whole collection) can lift a new document to the k-th partial score; after that, only accumulators that exist go on,
and theirs are exact. The k-th score of the shards a task has done before is the floor of the next ones. The best of all tasks
are then ranked together.

Documents of equal text are one entry of the index with a number of copies; copies count in all statistics and are listed again
at the end. Queries come in blocks of bounded text, so the words a task looks for stay bounded whatever the number of items.

Defined cases: null texts and texts without a term score nothing and do not count; rows of equal id and text all count as
documents but are listed once; rows without an id count and are not listed; an id with two texts is listed with each. Rows of one
item id are one query (its distinct texts together); items without terms have no rows. Equal scores go by document id. An empty
table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.tokens import release_encoders
from riskloom.operators.ordering import join_many_to_one

BLOCK_CHARS = 1 << 23  # text of the queries of one block
SHARD_ROWS, SHARD_ENTRIES = 1 << 15, 1 << 22  # documents and postings that a task ranks at a time
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """ASCII letters and digits and all other characters beyond ASCII make terms; A-Z are lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 100 - 25 + (25 * n * documents) // max(1, length)


@dataclass
class Queries:
    """The items of one block: their ids, their terms as numbers, and how often each term stands in each."""

    ids: list[int | None]
    numbers: dict[bytes, int]
    wanted: list[dict[int, int]]


def queries_of(rows: list[tuple[int | None, str]]) -> Queries:
    numbers: dict[bytes, int] = {}
    wanted = []
    for _, text in rows:
        counted = Counter(terms(text))
        wanted.append({numbers.setdefault(t, len(numbers)): n for t, n in counted.items()})
    return Queries([i for i, _ in rows], numbers, wanted)


def _entries(numbers: dict[bytes, int]):
    """doc_id, a 128-bit key of the text, the number of terms, and number and frequency of the wanted ones."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            keys, sizes, ends, found, counts = [], [], [0], [], []
            for text in batch["text"].to_pylist():
                raw = (text or "").encode()
                words = raw.translate(_FOLD).split()
                own = Counter(filter(None.__ne__, map(numbers.get, words)))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                sizes.append(len(words))
                found += own.keys()
                counts += own.values()
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, counts)]
            arrays = [batch["doc_id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "terms", "counts"])

    return entries


@dataclass
class Weights:
    """What a task needs of the whole collection: weight and largest impact of every term, documents with it."""

    documents: int
    length: int
    df: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    plans: list[list[tuple[int, int, int]]] = field(default_factory=list)  # per item: (term, factor, bound of the later ones)

    def plan(self, queries: Queries) -> None:
        for wanted in queries.wanted:
            order = sorted((t for t in wanted if self.df[t]), key=lambda t: (self.df[t], t))
            factors = [int(self.weight[t]) * wanted[t] for t in order]
            bounds = [f * int(self.most[t]) for f, t in zip(factors, order, strict=True)]
            later = np.cumsum([0, *bounds[::-1]])[::-1].tolist()
            self.plans.append([(t, f, b) for t, f, b in zip(order, factors, later, strict=False)])


def rank_shard(
    plan: list[tuple[int, int, int]], postings: dict[int, tuple[np.ndarray, np.ndarray]], rows: int, k: int, floor: int
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of all documents of a shard that can be among the best k; ``bound`` in a plan includes the term itself."""
    scores = np.zeros(rows, np.int64)
    known = np.zeros(rows, bool)
    creating = True
    for term, factor, bound in plan:
        if creating:
            touched = np.flatnonzero(known)
            kth = floor
            if len(touched) >= k:
                kth = max(kth, int(np.partition(scores[touched], len(touched) - k)[len(touched) - k]))
            creating = bound >= max(kth, 1)
        if term not in postings:
            continue
        at, value = postings[term]
        if creating:
            known[at] = True
            scores[at] += factor * value
        else:
            old = known[at]
            scores[at[old]] += factor * value[old]
    found = np.flatnonzero(known & (scores >= max(floor, 1)))
    return found, scores[found]


def _best(found: list[tuple[int, int, bytes]], k: int) -> list[tuple[int, int, bytes]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _ranker(weights: Weights, k: int):
    def flush(held: list[pa.RecordBatch], best: list[list[tuple[int, int, bytes]]]) -> None:
        table = pa.Table.from_batches(held)
        n = table["n"].to_numpy()
        sizes = table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        term = table["terms"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), sizes)
        tf = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        value = impact(tf, length_norm(n, weights.documents, weights.length)[row])
        order = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[order], prepend=-1))
        stops = np.append(cuts[1:], len(order))
        postings = {int(term[order[a]]): (row[order[a:b]], value[order[a:b]]) for a, b in zip(cuts, stops, strict=True)}
        first, keys = table["first"].to_numpy(), table["key"]
        for item, plan in enumerate(weights.plans):
            floor = best[item][k - 1][0] if len(best[item]) >= k else 0
            at, scores = rank_shard(plan, postings, len(n), k, floor)
            if not len(at):
                continue
            top = np.lexsort((first[at], -scores))[:k]
            fresh = [(int(scores[i]), int(first[at[i]]), keys[int(at[i])].as_py()) for i in top]
            best[item] = _best(best[item] + fresh, k)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, bytes]]] = [[] for _ in weights.plans]
        held, rows, entries = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                held.append(part := batch.slice(a, 2048))
                rows += part.num_rows
                entries += len(part["terms"].flatten())
                if rows >= SHARD_ROWS or entries >= SHARD_ENTRIES:
                    flush(held, best)
                    held, rows, entries = [], 0, 0
        if held:
            flush(held, best)
        for item, found in enumerate(best):
            if found:
                score, first, key = zip(*found, strict=True)
                arrays = [pa.array([item] * len(found), pa.int32()), pa.array(score, pa.int64()), pa.array(first, pa.int64()), pa.array(key, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["item", "score", "first", "key"])

    return rank


def _search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    schema = "doc_id bigint, key binary, n bigint, terms array<int>, counts array<int>"
    index = stored(docs.select("doc_id", "text").mapInArrow(_entries(queries.numbers), schema).where("n > 0"), "lexical-index")
    total = index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    documents, length = total["documents"], total["length"]
    # equal texts have equal entries: any one of them stands for all
    entry = F.any_value(F.struct("n", "terms", "counts"))
    texts = index.where(F.size("terms") > 0).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), entry.alias("e")
    )
    texts = stored(texts.select("key", "copies", "first", "e.*"), "lexical-texts")
    m = F.expr(f"75 + (25 * n * {documents}) div {max(1, length)}")
    pairs = texts.select("copies", m.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    pairs = pairs.select("copies", "m", F.col("p.terms").alias("term"), F.col("p.counts").cast("bigint").alias("tf"))
    value = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")
    # one row per term of the block
    rows = pairs.groupBy("term").agg(F.sum("copies").alias("df"), F.max(value).alias("most")).collect()
    size = len(queries.numbers)
    df, weight, most = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in rows:
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
        weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    weights = Weights(documents, length, df, weight, most)
    weights.plan(queries)
    ranked = texts.where("first is not null").select("key", "first", "n", "terms", "counts")
    best = stored(ranked.mapInArrow(_ranker(weights, k), "item int, score bigint, first bigint, key binary"), "lexical-best")
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "first", "key")
    best = best.withColumn("_place", F.row_number().over(by_item)).where(F.col("_place") <= k).select("item", "score", "key")
    best = stored(best, "lexical-top")
    # the copies of the texts found: at most k of each are listed
    copies = join_many_to_one(index.select("doc_id", "key").where("doc_id is not null"), best.select("key").distinct(), "key", ["doc_id"])
    of_text = Window.partitionBy("key").orderBy("doc_id")
    copies = copies.distinct().withColumn("_nth", F.row_number().over(of_text)).where(F.col("_nth") <= k).select("key", "doc_id")
    of_item = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    listed = best.join(copies, "key").withColumn("rank", F.row_number().over(of_item)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id bigint")
    return listed.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents above 0 for every item."""
    spark = docs.sparkSession
    one = F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text")
    asked = stored(items.where("text is not null").groupBy("item_id").agg(one), "lexical-items")
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for block in range(blocks):
        rows = asked.where(place == block).orderBy("item_id").collect()
        queries = queries_of([(r["item_id"], r["text"]) for r in rows])
        if queries.numbers:
            found.append(stored(_search_block(docs, queries, k), f"lexical-{block}") if blocks > 1 else _search_block(docs, queries, k))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionByName(one)
    return whole
