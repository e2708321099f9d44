"""Removal of lines that are, within a few edits, an earlier line of the corpus.

A line (trimmed, not empty) goes when the same line, or one within ``edits`` insertions, deletions and substitutions, stands
earlier: in a document of smaller id, or further up. Short lines may differ in less: one edit for every ``EDIT_CHARS``
characters of the shorter of two lines, so that lines below that go as exact repeats only. A caller that gives ``min_chars``
leaves shorter lines alone and compares all others with the full number of edits.

Lines are told apart by a 64-bit hash; texts are fetched for candidates only. The join of distinct lines is a
segment-partition join. A line is cut into one segment more than the edits its length allows; edits of two near lines leave
one segment of the shorter whole, and it stands in the longer one at a place that the lengths narrow down. Every line is
entered under (its length, segment number, segment) and asks for the substrings at those places, for each length up to
``edits`` below its own. Candidates that meet under a key are verified by a banded bit-parallel automaton: one bit per
diagonal and error count, all pairs of a batch stepping together.

Keys with few lines are paired by a join; keys with many are searched block against block inside tasks, which give back one
link per line at most.

Defined cases: null texts have no lines and stay null; empty lines stay; rows equal in doc_id and text count as one document;
a null doc_id sorts first; an empty table gives no rows. All columns of the input are kept in ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import let, stored
from riskloom.llm.shingles import mix
from riskloom.llm.tokens import batches_by_size, release_encoders

EDITS, EDIT_CHARS = 2, 12
PAIR_LINES, BLOCK = 24, 512
CELLS = 1 << 22  # characters of a batch of pairs
SEEN_LINES = 500_000  # lines a task remembers, so as not to enter them again
TRIMMED = " \t\r\x0b\x0c"


@dataclass(frozen=True)
class Reach:
    """How many edits two lines may be apart, by the length of the shorter; lines below ``least`` are left alone."""

    edits: int
    least: int = 1
    step: int = EDIT_CHARS  # characters to an edit; 0: all edits at any length

    def of(self, lengths: np.ndarray) -> np.ndarray:
        own = np.minimum(self.edits, lengths // self.step) if self.step else np.full(len(lengths), self.edits)
        return np.where(lengths >= self.least, own, 0)


def reach_of(min_chars: int | None, edits: int) -> Reach:
    return Reach(edits) if min_chars is None else Reach(edits, max(1, min_chars), 0)


def document_key() -> Column:
    """Identity of a document: its id and its text."""
    return F.xxhash64("doc_id", "text")


class _Hashes:
    """Hashes of stretches of text: a polynomial modulo 2**64 from running sums over the code points of many lines."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * powers[:n], out=self.sums[1:])
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, start: np.ndarray, size: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hash of ``size`` characters from ``start`` on of each (chosen) line."""
        at = self.starts[which] + start
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + size.astype(np.uint64))

    def lines(self) -> np.ndarray:
        return self.of(np.zeros_like(self.lengths), self.lengths).view(np.int64)


def _lines_of(texts: list[str | None], min_chars: int) -> tuple[list[str], list[int], list[int]]:
    """Trimmed lines of at least so many characters, the row and the number of each."""
    lines, rows, numbers = [], [], []
    for row, text in enumerate(texts):
        for number, line in enumerate(text.split("\n") if text else ()):
            line = line.strip(TRIMMED)
            if len(line) >= min_chars:
                lines.append(line)
                rows.append(row)
                numbers.append(number)
    return lines, rows, numbers


def _occurrences(min_chars: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in batches_by_size(texts):
                lines, rows, numbers = _lines_of(texts[a:b], min_chars)
                if lines:
                    at = pa.array(rows) if not a else pa.array([a + r for r in rows])
                    own = [batch["doc_id"].take(at), batch["document"].take(at)]
                    own += [pa.array(numbers, pa.int32()), pa.array(_Hashes(lines).lines())]
                    yield pa.RecordBatch.from_arrays(own, ["doc_id", "document", "line_no", "line_id"])

    return occurrences


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, document, line_no (from 0) and line_id, a hash of the trimmed line, of all lines that long."""
    rows = docs.select("doc_id", document_key().alias("document"), "text")
    return rows.mapInArrow(_occurrences(min_chars), "doc_id bigint, document bigint, line_no int, line_id bigint")


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) at which a segment of the shorter line can stand in the longer."""
    places = []
    for shorter_by in range(edits + 1):
        for number in range(edits + 1):
            low = max(-number, shorter_by - (edits - number))
            high = min(number, shorter_by + (edits - number))
            places += [(shorter_by, number, shift) for shift in range(low, high + 1)]
    return places


def line_keys(lines: list[str], reach: Reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, entered) of all lines: entered keys are a line's own segments, the others only ask.

    A line that allows ``edits`` has ``edits + 1`` segments of equal length, the last ones longer by one where it does not
    divide. Lines that allow none have no keys.
    """
    hashes, found = _Hashes(lines), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
    for edits in range(1, reach.edits + 1):
        parts = edits + 1
        for shorter_by, number, shift in probe_places(edits):
            length = hashes.lengths - shorter_by
            short, longer = length // parts, length % parts
            size = short + (number >= parts - longer)
            start = number * short + np.maximum(0, number - (parts - longer)) + shift
            which = np.flatnonzero((reach.of(length) == edits) & (start >= 0) & (start + size <= hashes.lengths))
            place = length[which].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(number + 1)
            keys = mix(hashes.of(start[which], size[which], which) ^ mix(place))
            found.append((keys.view(np.int64), which, np.full(len(which), shorter_by == 0 and shift == 0)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys(reach: Reach):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in batches_by_size(texts):
                lines = list(dict.fromkeys(_lines_of(texts[a:b], reach.least)[0]))
                if not lines:
                    continue
                ids = _Hashes(lines).lines()
                fresh = [i for i, x in enumerate(ids.tolist()) if x not in seen]
                seen.update(ids[fresh].tolist())
                if len(seen) > SEEN_LINES:
                    seen.clear()
                if fresh:
                    key, which, entered = line_keys([lines[i] for i in fresh], reach)
                    arrays = [pa.array(key), pa.array(ids[fresh][which]), pa.array(entered)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "line_id", "entered"])

    return keys


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row of a matrix each, filled up with 0, and their lengths."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    matrix = np.zeros((len(lines), int(lengths.max(initial=0))), np.uint32)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = flat
    return matrix, lengths


def within_edits(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair of lines is within ``edits``: the automaton of all pairs, in batches of like length."""
    longest = np.fromiter((max(len(a), len(b), 1) for a, b in zip(left, right, strict=True)), np.int64, len(left))
    order, found, start = np.argsort(-longest, kind="stable"), np.zeros(len(left), bool), 0
    while start < len(order):
        stop = start + max(1, CELLS // int(longest[order[start]]))
        part = order[start:stop]
        found[part] = _automaton([left[i] for i in part], [right[i] for i in part], edits)
        start = stop
    return found


def near(left: list[str], right: list[str], reach: Reach) -> np.ndarray:
    """Whether each pair of lines is within the edits that the shorter one allows."""
    shorter = np.fromiter((min(len(a), len(b)) for a, b in zip(left, right, strict=True)), np.int64, len(left))
    allowed, found = reach.of(shorter), np.zeros(len(left), bool)
    for edits in np.unique(allowed).tolist():
        part = np.flatnonzero(allowed == edits)
        found[part] = within_edits([left[i] for i in part], [right[i] for i in part], edits)
    return found


def _automaton(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Bit ``d`` of ``state[e]``: the text so far matches the pattern up to ``d - edits`` further on with at most e errors."""
    pattern, m = _codes(left)
    text, n = _codes(right)
    width = 2 * edits + 1
    full = np.uint32((1 << width) - 1)
    by_length = np.argsort(-n, kind="stable")
    pattern, m, text, n = pattern[by_length], m[by_length], text[by_length], n[by_length]
    # columns of the pattern shifted so that column j + d holds the character of diagonal d at text place j
    padded = np.zeros((len(m), text.shape[1] + 2 * width), np.uint32)
    reach = min(pattern.shape[1], padded.shape[1] - edits)
    padded[:, edits : edits + reach] = pattern[:, :reach]
    state = np.zeros((edits + 1, len(m)), np.uint32)
    for e in range(edits + 1):
        state[e] = (1 << (edits + e + 1)) - (1 << edits)  # e leading pattern characters left out
    alive = np.searchsorted(-n, -np.arange(1, text.shape[1] + 1), side="right")
    for j, count in enumerate(alive):
        equal = np.zeros(count, np.uint32)
        char = text[:count, j]
        for d in range(width):
            equal |= (padded[:count, j + d] == char).astype(np.uint32) << np.uint32(d)
        before = state[:, :count].copy()
        state[0, :count] = before[0] & equal
        for e in range(1, edits + 1):
            moved = (before[e] & equal) | before[e - 1] | (before[e - 1] >> np.uint32(1)) | (state[e - 1, :count] << np.uint32(1))
            state[e, :count] = moved & full
    goal = m - n + edits
    found = np.zeros(len(m), bool)
    near = (goal >= 0) & (goal < width)
    found[by_length[near]] = (state[edits, near] >> goal[near].astype(np.uint32)) & 1 == 1
    return found


def _verify(reach: Reach):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(near(batch["left"].to_pylist(), batch["right"].to_pylist(), reach), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return verify


def _profiles(lines: list[str]) -> np.ndarray:
    """How many characters of each of 32 kinds a line has; an edit changes two of the counts by one at most."""
    matrix, lengths = _codes(lines)
    kinds = (matrix * np.uint32(2654435761)) >> np.uint32(27)
    counts = np.zeros((len(lines), 32), np.int32)
    row = np.repeat(np.arange(len(lines)), lengths)
    np.add.at(counts, (row, kinds[np.arange(matrix.shape[1]) < lengths[:, None]]), 1)
    return counts


def _block_search(reach: Reach):
    """Per line, one earlier line near it in the other block (or its own), if there is one."""
    import pandas as pd

    def search(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        lines, ids, entered = group["line"].tolist(), group["line_id"].to_numpy(), group["entered"].to_numpy(bool)
        home, profile = group["home"].to_numpy(), _profiles(lines)
        order = np.lexsort([group[c].to_numpy() for c in ("at_line", "at_document", "at_doc")])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, todo = [], []

        def settle_pairs() -> None:
            earlier, later = (np.array(x) for x in zip(*todo, strict=True))
            close = near([lines[i] for i in earlier], [lines[i] for i in later], reach)
            done, first = np.unique(later[close], return_index=True)
            found.extend(zip(ids[earlier[close][first]], ids[done], strict=True))
            todo.clear()

        for i in range(len(lines)):
            met = (home == (high if home[i] == low else low)) & (place < place[i]) & (entered | entered[i]) & (ids != ids[i])
            met = np.flatnonzero(met)
            apart = np.abs(profile[met] - profile[i]).sum(axis=1)
            todo += [(j, i) for j in met[apart <= 2 * reach.edits]]
            if len(todo) > 20_000:
                settle_pairs()
        if todo:
            settle_pairs()
        return pd.DataFrame(found, columns=["a", "b"]).drop_duplicates("b").astype("int64")

    return search


def near_lines(docs: DataFrame, firsts: DataFrame, reach: Reach) -> DataFrame:
    """line_id of every distinct line that stands within ``reach`` of an earlier one.

    ``firsts`` is a stored table of ``(line_id, first)`` where first is the struct (doc_id, document, line_no). Lines go by
    their hash until candidates are known; only then are their texts fetched, each from its first document.
    """
    keyed = docs.select("text").mapInArrow(_keys(reach), "key bigint, line_id bigint, entered boolean")
    of_key = Window.partitionBy("key")
    met = keyed.select(
        "key", "line_id", "entered",
        F.min("line_id").over(of_key).alias("_low"), F.max("line_id").over(of_key).alias("_high"),
        F.max("entered").over(of_key).alias("_any"),
    ).where("_any and _low <> _high")
    live = stored(met.groupBy("key", "line_id").agg(F.max("entered").alias("entered")), "line-keys")
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = live.select("line_id").distinct().join(firsts, "line_id")
    # a document is split once for all of its wanted lines, and rows equal in id and text stand for one
    place = F.struct("line_id", "first", F.col("first.line_no").alias("_no"))
    places = wanted.select(F.col("first.document").alias("document"), place.alias("p")).groupBy("document").agg(F.collect_list("p").alias("places"))
    whole = docs.select(document_key().alias("document"), "text").join(places, "document").dropDuplicates(["document"])

    def fetched(lines: Column) -> Column:
        line = lambda p: F.trim(F.get(lines, p["_no"]), F.lit(TRIMMED))
        return F.transform("places", lambda p: F.struct(p["line_id"].alias("line_id"), p["first"].alias("first"), line(p).alias("line")))

    texts = stored(whole.select(F.inline(let(F.split("text", "\n"), fetched))), "line-texts")

    few = live.join(sizes.where(F.col("n") <= PAIR_LINES).select("key"), "key")
    one = few.where("entered").select("key", F.col("line_id").alias("x"))
    pairs = one.join(few.select("key", F.col("line_id").alias("y")), "key").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = (texts.select(F.col("line_id").alias(n), F.col("line").alias(side)) for n, side in (("a", "left"), ("b", "right")))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(reach), "a bigint, b bigint")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = live.join(sizes.where(F.col("n") > PAIR_LINES), "key")
    placed = many.withColumn("home", F.pmod(F.xxhash64("line_id"), blocks).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "line_id", "entered", "home", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high")
    )
    full = spread.join(texts, "line_id").select(
        *spread.columns, "line", F.col("first.doc_id").alias("at_doc"), F.col("first.document").alias("at_document"),
        F.col("first.line_no").alias("at_line"),
    )
    full = full.na.fill(-(1 << 63), ["at_doc"])
    links = links.unionByName(full.groupBy("key", "low", "high").applyInPandas(_block_search(reach), "a bigint, b bigint"))

    place = texts.select("line_id", "first")
    later = links.distinct().join(place.toDF("a", "first_a"), "a").join(place.toDF("b", "first_b"), "b")
    return later.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("line_id")).distinct()


def repeated_lines(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS) -> DataFrame:
    """document and removed (ascending line numbers) for every document that loses lines."""
    reach = reach_of(min_chars, edits)
    seen = stored(line_occurrences(docs, reach.least), "lines")
    first = F.min(F.struct("doc_id", "document", "line_no")).alias("first")
    firsts = stored(seen.groupBy("line_id").agg(first, F.count(F.lit(1)).alias("n")), "first-lines")
    gone = near_lines(docs, firsts.select("line_id", "first"), reach).withColumn("gone", F.lit(True))
    known = firsts.join(gone, "line_id", "left").where("n > 1 or gone")
    known = stored(known.select("line_id", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "repeated-lines")
    met = seen.select("line_id", "document", "line_no").join(known, "line_id")
    removed = met.where(F.col("gone") | (F.col("document") != F.col("first.document")) | (F.col("line_no") != F.col("first.line_no")))
    return removed.groupBy("document").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def removals(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_removed and removed line numbers of every row."""
    gone = stored(repeated_lines(docs, min_chars, edits), "removed-lines")
    rows = docs.select(
        "doc_id", document_key().alias("document"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")
    )
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    joined = rows.join(gone, "document", "left")
    return joined.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def without_repeats(
    docs: DataFrame, min_chars: int | None = None, edits: int = EDITS, length_column: str | None = None
) -> DataFrame:
    """The documents with their repeated lines taken out; those left without a single word go.

    ``length_column`` is set anew for texts that changed.
    """
    gone = stored(repeated_lines(docs, min_chars, edits), "removed-lines").toDF("_document", "_removed")

    def rest(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    joined = docs.join(gone, document_key() == gone["_document"], "left")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    rebuilt = joined.withColumn("text", text)
    if length_column:
        kept = F.when(F.col("_removed").isNull(), F.col(length_column)).otherwise(F.char_length("text"))
        rebuilt = rebuilt.withColumn(length_column, kept.cast(docs.schema[length_column].dataType))
    emptied = F.col("_removed").isNotNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rebuilt.where(~emptied).select(*docs.columns)
