"""Language-model scores by prediction by partial matching over bytes, and by word frequencies as a base.

A text is its words (A-Z lower-cased), each closed by a space, and one end. Bytes are predicted from the longest context seen in
training, at most ``ORDER`` bytes. A byte the context has not seen escapes to the next
shorter one: the escape takes as many counts as the context has different bytes, and bytes already ruled out by longer contexts
are excluded from the counts of shorter ones. Below the empty context all bytes left are equal. The sum over all bytes is the
log10 probability of the text.

With ``whole_texts`` contexts run on across words, back to the space before the first word of the text; this is the model of the
registered query. Without it they stop at the space before the word, a coarser model in which a word has one code length wherever
it stands. The trie is gathered from every training text (or word) and leaves nothing out. It is no object in a task but tables,
one row for a pair of a context and a byte and one for a context, which grow with the corpus; what it has to say about a byte is
found by joins. A shorter context has at most 256 longer ones, so no row of these tables is met by many others.

The corpus is read once for the counts of its words and once to add up every text; with ``whole_texts`` once more for the bytes
with what stands before them, their histories. A task counts its own and hands them on in blocks, one for each of as many hashed
cells as the texts have ``CELL_BYTES``, where the counts of all tasks are added.

Only what is frequent goes to the tasks, a bounded number: bytes with their histories (the ``2 ** HISTORY_BITS`` most frequent of
the texts, or more than one in ``2 ** HEAD_BITS`` of those of the words), and words that make up more than one in
``2 ** HEAD_BITS``. The others are joined.

Defined cases: null texts count as empty and hold the end only; rows without an id are held out (they have no remainder) and are
scored; repeated rows count and are scored each; without training texts every byte is equal and ``N`` is 0; an empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.tokens import batches_by_size, release_encoders, text_ranges

ORDER = 6
HEAD_BITS = 20
END = b"\n"  # no word holds it
HISTORY_BITS = 21
COUNTED_WORDS, COUNTED_BYTES = 200_000, 1 << 24  # words a task counts before it hands them on
COUNTED_HISTORIES = 3 << 20  # histories a task holds before it adds them up, and hands them on if three quarters are left
RANGE_BYTES = 1 << 20  # of texts whose histories a task holds one by one
SORTED_RANGES = 4  # of those, whose histories are sorted at once; the more, the fewer are left to be added up
CELL_BYTES = 1 << 24
_ORDERS = np.uint64(56)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPREADS = (_SPREAD, np.uint64(0xC2B2AE3D27D4EB4F))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(True))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _raw(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


# ---- counts of words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, seen): how often each word stands in training texts, and that it stands anywhere."""
    release_encoders()
    train: Counter[bytes] = Counter()
    other: set[bytes] = set()

    def handed() -> Iterator[pa.RecordBatch]:
        words = list(train)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(train.values()), pa.int64())], ["word", "n"])
        rest = [w for w in other if w not in train]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.binary()), pa.array(np.zeros(len(rest), np.int64))], ["word", "n"])
        train.clear()
        other.clear()

    size = 0
    for batch in batches:
        for apart, text in zip(batch["held_out"].to_pylist(), _raw(batch["text"]), strict=True):
            words = tokens(text)
            size += len(text)
            if apart:
                other.update(words)
            else:
                train.update(words)
            if size > COUNTED_BYTES and (len(train) + len(other) > COUNTED_WORDS or size > 8 * COUNTED_BYTES):
                yield from handed()
                size = 0
    yield from handed()


# ---- the trie


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(history, word number) of every byte of the words and their closing spaces.

    A history is an integer of the byte, the up to ``ORDER`` bytes before it, the nearest lowest, and the number of those.
    """
    data = np.frombuffer(b"".join(b" " + (w if w == END else w + b" ") for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + np.array([1 if w == END else 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)  # 0 is the space before the word
    owner = np.repeat(np.arange(len(words)), lengths)
    history = np.zeros(len(data), np.uint64)
    for back in range(1, ORDER + 1):
        earlier = np.zeros(len(data), np.uint64)
        earlier[back:] = data[:-back]
        history |= np.where(place >= back, earlier, 0) << np.uint64(8 * back)
    history |= data | (np.minimum(place, ORDER).astype(np.uint64) << _ORDERS)
    coded = place > 0
    return history[coded], owner[coded]


def written(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Histories, as in ``spelled``, of every byte of whole texts given as their tokens, and their number for each text."""
    streams = [b" " + b" ".join(words[:-1]) + (b" " if len(words) > 1 else b"") + END for words in texts]
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    data = bytes(7) + b"".join(streams)
    history = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)  # the eight bytes up to every place
    history &= np.uint64((1 << 8 * (ORDER + 1)) - 1)
    history |= np.uint64(ORDER) << _ORDERS
    first = np.cumsum(lengths) - lengths
    for place in range(1, ORDER):
        at = (first + place)[lengths > place]
        history[at] = (history[at] & np.uint64((1 << 8 * (place + 1)) - 1)) | (np.uint64(place) << _ORDERS)
    coded = np.ones(len(history), bool)
    coded[first] = False
    return history[coded], lengths - 1


def _packed(*columns: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: most planes hold one value."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    planes = np.frombuffer(pa.decompress(block[8:], 8 * columns * size, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in planes.reshape(columns, 8, size)]


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct histories of all parts in order, with their counts added up; a column at a time, which halves the work space.

    Every part is in order, so that a stable sort only merges them.
    """
    history = np.concatenate([p[0] for p in parts])
    order = np.argsort(history, kind="stable")
    history = history[order]
    first = np.ones(len(history), bool)
    first[1:] = history[1:] != history[:-1]
    places, history = np.flatnonzero(first), history[first]
    sums = (np.add.reduceat(np.concatenate([p[i] for p in parts])[order], places, dtype=parts[0][i].dtype) for i in range(1, len(parts[0])))
    return history, *sums


def _text_histories(cells: int):
    """(cell, block): the histories of a task's texts by cells of their hash, with how often they stand in all and in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        held: list[tuple[np.ndarray, ...]] = []

        def handed() -> Iterator[pa.RecordBatch]:
            history, uses, n = held.pop()
            cell = ((history * _SPREAD) >> np.uint64(32)) % np.uint64(cells)
            order = np.argsort(cell, kind="stable")
            found, starts = np.unique(cell[order], return_index=True)
            for c, at in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                block = _packed(np.diff(history[at], prepend=np.uint64(0)), uses[at].astype(np.uint64), n[at].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([block], pa.binary())], ["cell", "block"])

        size = places = 0
        for batch in batches:
            apart = batch["held_out"].to_numpy(zero_copy_only=False)
            for a, b, texts in text_ranges(batch["text"].fill_null("").cast(pa.binary()), SORTED_RANGES * RANGE_BYTES):
                history, lengths = written([tokens(t) for t in texts])
                learned = np.repeat(~apart[a:b], lengths)
                for mine, trained in ((history[learned], 1), (history[~learned], 0)):
                    if len(mine):
                        distinct, uses = np.unique(mine, return_counts=True)
                        held.append((distinct, uses.astype(np.uint32), (uses * trained).astype(np.uint32)))
                        size += len(distinct)
                places += len(history)
                if size > COUNTED_HISTORIES or places >> 31:  # the counts have 32 bits
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if 4 * size > 3 * COUNTED_HISTORIES or places >> 31:
                        yield from handed()
                        size = places = 0
        if held:
            held = [_summed(held)]
            yield from handed()

    return count


def _cell_histories(blocks: pa.Table) -> pa.Table:
    """The histories of one cell, with the counts of all tasks added up."""
    parts = [_unpacked(x.as_py(), 3) for x in blocks["block"]]
    history, uses, n = _summed([(np.cumsum(h), u, n) for h, u, n in parts])
    return pa.table({"history": history.view(np.int64), "uses": uses.view(np.int64), "n": n.view(np.int64)})


def text_histories(texts: DataFrame) -> DataFrame:
    """(history, uses, n) of all whole texts: how often a byte stands with this history, and how often in training texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = texts.select("held_out", "text").mapInArrow(_text_histories(size // CELL_BYTES + 1), "cell bigint, block binary")
    return blocks.groupBy("cell").applyInArrow(_cell_histories, "history bigint, uses bigint, n bigint")


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(history, uses, n): how many distinct words hold a byte with this history, and how often it stands in training texts."""
    for batch in batches:
        words, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
        for a, b in batches_by_size(words, 1 << 20):
            history, owner = spelled(words[a:b])
            distinct, at = np.unique(history, return_inverse=True)
            n = np.bincount(at, counts[a:b][owner], len(distinct)).astype(np.int64)
            uses = np.bincount(at, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(uses), pa.array(n)], ["history", "uses", "n"])


def _shorter(name: str, order: str) -> Column:
    """``name``, a history, pair or context, with its last ``order`` bytes of context only."""
    return F.expr(f"({name} & (shiftleft(1L, 8 * ({order}) + 8) - 1)) | shiftleft(CAST({order} AS BIGINT), 56)")


def _order(name: str) -> Column:
    return F.expr(f"CAST(shiftright({name}, 56) AS INT)")


def _context(name: str) -> Column:
    return F.expr(f"{name} & -256L")


def trie_pairs(histories: DataFrame) -> DataFrame:
    """(pair, n): how often a byte follows a context in training, for the contexts of all orders."""
    seen = histories.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), _order("history"))))
    return seen.select(_shorter("history", "k").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def trie_contexts(pairs: DataFrame) -> DataFrame:
    """Per context: total, kinds, the log10 of its escape, and what it leaves to the next shorter one.

    ``whole`` are the counts of the next shorter context without the bytes seen here, with its escapes, and ``step`` is the
    log10 of escaping from there too; both are null for the empty context.
    """
    longer = pairs.where(_order("pair") > 0).select("pair", _shorter("pair", "shiftright(pair, 56) - 1").alias("below"))
    counts = pairs.select(F.col("pair").alias("below"), F.col("n").alias("taken"))
    taken = longer.join(counts, "below").groupBy(_context("pair").alias("context")).agg(F.sum("taken").alias("taken"))
    sums = pairs.groupBy(_context("pair").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    sums = stored(sums.join(taken, "context", "left"), "context-sums")
    below = sums.select(F.col("context").alias("below"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
    own = sums.withColumn("below", F.when(_order("context") > 0, _shorter("context", "shiftright(context, 56) - 1")))
    left, kinds = F.col("_total") - F.col("taken"), F.col("_kinds") - F.col("kinds")
    whole = F.greatest(left + kinds, F.lit(1))
    # a context without new bytes is passed through
    step = F.when(kinds > 0, F.log10(kinds / whole)).when(kinds == 0, F.lit(0.0))
    escape = F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))
    return own.join(below, "below", "left").select("context", "total", "kinds", escape.alias("escape"), whole.alias("whole"), step.alias("step"))


def _descended(unseen: DataFrame, pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(history, code) of histories not seen in training: the escapes down to the order that has the byte."""
    levels = unseen.withColumn("k", F.explode(F.sequence(F.lit(0), _order("history")))).withColumn("pair", _shorter("history", "k"))
    levels = levels.withColumn("context", _context("pair"))
    # the pairs and contexts of the two shortest orders are 2 ** 16 + 2 ** 8 at most, and met by all
    parts = []
    for short in (True, False):
        mine = levels.where((F.col("k") < 2) == short)
        pair, context = pairs.where((_order("pair") < 2) == short), contexts.where((_order("context") < 2) == short)
        if short:
            pair, context = F.broadcast(pair), F.broadcast(context)
        parts.append(mine.join(pair, "pair", "left").join(context, "context", "left"))
    met = parts[0].unionByName(parts[1]).groupBy("history").agg(
        F.max(F.when(F.col("n").isNotNull(), F.struct("k", "n"))).alias("found"),
        F.max(F.when(F.col("kinds").isNotNull(), F.struct("k", "total", "kinds", "escape"))).alias("top"),
        F.collect_list(F.struct("k", "kinds", "whole", "step")).alias("levels"),
    )
    at = F.coalesce(F.col("found.k"), F.lit(-1))
    direct = F.log10(F.col("found.n") / (F.col("top.total") + F.col("top.kinds")))

    def term(x: Column) -> Column:
        last = F.when(at < 0, -F.log10(F.greatest(F.lit(256) - x["kinds"], F.lit(1)))).otherwise(F.log10(F.col("found.n") / x["whole"]))
        return F.when(x["k"] > F.col("top.k"), F.lit(0.0)).when(x["k"] > at + 1, x["step"]).when(x["k"] == at + 1, last).otherwise(F.lit(0.0))

    down = F.col("top.escape") + F.aggregate("levels", F.lit(0.0), lambda total, x: total + term(x))
    code = F.when(F.col("top").isNull(), -F.log10(F.lit(256.0))).when(at == F.col("top.k"), direct).otherwise(down)
    return met.select("history", code.alias("code"))


def code_lengths(histories: DataFrame) -> DataFrame:
    """(history, uses, code): the log10 probability of every byte after what stands before it."""
    pairs = stored(trie_pairs(histories), "trie-pairs")
    contexts = stored(trie_contexts(pairs), "trie-contexts")
    long = _order("history") == ORDER
    seen = histories.where("n > 0").select("history", "uses", "n")
    # what stands at the start of a text with fewer bytes before it stands elsewhere after more
    short = seen.where(~long).drop("n").join(pairs.select(F.col("pair").alias("history"), "n"), "history")
    seen = seen.where(long).unionByName(short).withColumn("context", _context("history")).join(contexts, "context")
    seen = seen.select("history", "uses", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("code"))
    unseen = histories.where("n = 0")
    return seen.unionByName(unseen.select("history", "uses").join(_descended(unseen.select("history"), pairs, contexts), "history"))


# ---- scores


def _listed(keys: np.ndarray, owner: np.ndarray, owners: int) -> list[pa.Array]:
    """Distinct keys of every owner and their numbers, as two columns of lists."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(owner) != 0) | (keys[1:] != keys[:-1])
    places = np.flatnonzero(first)
    uses = np.diff(np.append(places, len(order)))
    offsets = pa.array(np.searchsorted(owner[places], np.arange(owners + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys[places].view(np.int64), uses)]


class _Codes:
    """Codes of frequent histories, given with the most frequent last: slots for hashes, of several in one the last stays.

    Those that are left have slots for another hash, and the few left there are searched in order. A history lies next to its code,
    and the frequent ones next to each other.
    """

    def __init__(self, histories: np.ndarray, codes: np.ndarray):
        self.none = len(histories)  # the last place: not a history that is held
        self.pairs = np.empty((self.none + 1, 2))
        self.pairs[:, 0] = np.append(histories, ~np.uint64(0)).view(np.float64)
        self.pairs[:, 1] = np.append(codes, 0.0)
        self.pairs = self.pairs.view(np.complex128).ravel()
        left, self.tables = np.arange(self.none, dtype=np.int32), []
        for i, spread in enumerate(_SPREADS):
            shift = np.uint64(63 - max(1, self.none.bit_length() - i))
            slots = np.full(1 << (64 - int(shift)), self.none, np.int32)
            places = ((histories[left] * spread) >> shift).view(np.int64)
            slots[places] = left
            self.tables.append((spread, shift, slots))
            left = left[slots[places] != left]
        order = np.argsort(histories[left])
        self.rest, self.searched = np.append(left[order], np.int32(self.none)), np.append(histories[left[order]], ~np.uint64(0))

    def _held(self, table: int, histories: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places by one of the hashes, the codes there, and which histories are not those."""
        spread, shift, slots = self.tables[table]
        at = slots.take(((histories * spread) >> shift).view(np.int64))
        pairs = self.pairs.take(at).view(np.float64).reshape(-1, 2)
        return at, pairs[:, 1], np.flatnonzero(pairs[:, 0].view(np.uint64) != histories)

    def find(self, histories: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of every history, 0 where it is not held, and the places of those."""
        _, codes, missing = self._held(0, histories)
        own = histories[missing]
        at, _, other = self._held(1, own)
        behind = np.searchsorted(self.searched, own[other])
        behind[self.searched[behind] != own[other]] = len(self.rest) - 1
        at[other] = self.rest[behind]
        codes[missing] = self.pairs.take(at).imag
        return codes, missing[at == self.none]


def _rated(histories: np.ndarray, codes: np.ndarray):
    """Sums of the frequent histories of every distinct word, and its other histories with their number."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId() << 40, 0
        known, table = np.append(histories, ~np.uint64(0)), np.append(codes, 0.0)  # the last one: not a frequent history
        for batch in batches:
            words = batch["word"].to_pylist()
            for a, b in batches_by_size(words, 1 << 20):
                history, owner = spelled(words[a:b])
                at = np.searchsorted(known, history)
                at[known[at] != history] = len(histories)
                code = np.bincount(owner, table[at], b - a)
                other = np.flatnonzero(at == len(histories))
                lists = _listed(history[other], owner[other], b - a)
                columns = [pa.array(task + row + np.arange(b - a)), batch["word"].slice(a, b - a), batch["n"].slice(a, b - a), pa.array(code), *lists]
                row += b - a
                yield pa.RecordBatch.from_arrays(columns, ["row", "word", "n", "code", "rare", "uses"])

    return rate


def rated_words(counts: DataFrame, head_bits: int) -> DataFrame:
    """(word, n, code) of every distinct word of ``(word, n)``, its closing space included."""
    found = counts.mapInArrow(_histories, "history bigint, uses bigint, n bigint").groupBy("history")
    found = stored(found.agg(F.sum("uses").alias("uses"), F.sum("n").alias("n")), "histories")
    codes = stored(code_lengths(found), "history-codes")
    size = found.agg(F.sum("uses")).first()[0] or 0
    head = codes.where(F.col("uses") * F.lit(1 << head_bits) > F.lit(size)).select("history", "code").toArrow().sort_by("history")
    rate = _rated(head["history"].to_numpy().view(np.uint64), head["code"].to_numpy())
    schema = "row bigint, word binary, n bigint, code double, rare array<bigint>, uses array<bigint>"
    sums = stored(counts.mapInArrow(rate, schema), "word-sums")
    each = sums.select("row", F.explode(F.arrays_zip("rare", "uses")).alias("h")).select("row", F.col("h.rare").alias("history"), F.col("h.uses").alias("times"))
    rest = each.join(codes.select("history", F.col("code").alias("_code")), "history").groupBy("row").agg(F.sum(F.col("times") * F.col("_code")).alias("_rest"))
    return sums.join(rest, "row", "left").select("word", "n", (F.col("code") + F.coalesce("_rest", F.lit(0.0))).alias("code"))


def frequent(codes: DataFrame, bits: int) -> pa.Table:
    """(history, code) of the most frequent histories, ``2 ** bits`` at most, the most frequent last."""
    level = F.floor(4 * F.log2("uses"))
    least, held = None, 0
    for r in sorted(codes.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > 1 << bits:
            break
        least = r["level"]
    chosen = codes.where(level >= F.lit(least)).select("history", "code", "uses").toArrow()
    return chosen.sort_by([("uses", "ascending"), ("history", "ascending")])


def _added(words: list[bytes], figures: np.ndarray, histories: np.ndarray | None = None, codes: np.ndarray | None = None):
    """Sums over the frequent words of every text, and its other words with their frequency.

    With ``histories`` the code of a text is the sum over its frequent histories, and its other histories are listed, too.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        numbers = {w: i for i, w in enumerate(words)}
        task, row = TaskContext.get().partitionId() << 40, 0
        table = np.concatenate([figures, np.zeros((1, 3))])  # the last one: not a frequent word
        known = None if histories is None else _Codes(histories, codes)
        for batch in batches:
            for a, b, texts in text_ranges(batch["text"].fill_null("").cast(pa.binary()), RANGE_BYTES):
                own = [tokens(t) for t in texts]
                lengths = np.fromiter(map(len, own), np.int64, b - a)
                ends = np.cumsum(lengths)
                every = list(chain.from_iterable(own))
                at = np.fromiter((numbers.get(w, -1) for w in every), np.int64, len(every))
                sums = [np.add.reduceat(table[at, i], ends - lengths) for i in range(3)]
                rest, counts, offsets = [], [], [0]
                missing = np.flatnonzero(at < 0)
                cuts = np.searchsorted(missing, ends)
                start = 0
                for stop in cuts.tolist():
                    rare = Counter([every[i] for i in missing[start:stop].tolist()])
                    rest += rare.keys()
                    counts += rare.values()
                    offsets.append(len(rest))
                    start = stop
                ends_of = pa.array(offsets, pa.int32())
                lists = [
                    pa.ListArray.from_arrays(ends_of, pa.array(rest, pa.binary())),
                    pa.ListArray.from_arrays(ends_of, pa.array(counts, pa.int64())),
                ]
                if known is not None:
                    history, sizes = written(own)
                    stops = np.cumsum(sizes)
                    code, other = known.find(history)
                    sums[2] = np.add.reduceat(code, stops - sizes)
                    lists += _listed(history[other], np.searchsorted(stops, other, side="right"), b - a)
                arrays = [pa.array(task + row + np.arange(b - a)), batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a)]
                arrays += [pa.array(lengths), *map(pa.array, sums), *lists]
                row += b - a
                names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "code", "rare", "counts", "histories", "times"]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return add


def scores(docs: DataFrame, head_bits: int = HEAD_BITS, whole_texts: bool = False, history_bits: int = HISTORY_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row; held-out rows are not learned from.

    Contexts run on across the words of a text with ``whole_texts``, and stop at the space before a word without.
    """
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    counts = texts.select("held_out", "text").mapInArrow(_counted, "word binary, n bigint")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    base = F.log10((F.col("n") + 0.1) / F.lit((total["n"] + 0.1 * (total["kinds"] + 1))))
    if whole_texts:
        rated = counts.select("word", "n", base.alias("base"), F.lit(0.0).alias("code"))
        codes = stored(code_lengths(stored(text_histories(texts), "histories")), "history-codes")
        known = frequent(codes, history_bits)
        coded = [known["history"].to_numpy().view(np.uint64), known["code"].to_numpy()]
    else:
        rated = stored(rated_words(counts, head_bits).select("word", "n", base.alias("base"), "code"), "word-scores")
        coded = []
    # fewer than 2 ** head_bits words can each be more than that share of all
    head = rated.where((F.col("n") > 0) & (F.col("n") * F.lit(1 << head_bits) > F.lit(total["n"]))).toArrow()
    figures = np.stack([np.ones(head.num_rows), head["base"].to_numpy(), head["code"].to_numpy()], axis=1)
    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known double, base double, code double, "
        "rare array<binary>, counts array<bigint>" + ", histories array<bigint>, times array<bigint>" * whole_texts
    )
    added = stored(texts.mapInArrow(_added(head["word"].to_pylist(), figures, *coded), schema), "text-sums")
    each = added.select("row", F.explode(F.arrays_zip("rare", "counts")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.counts").alias("tf"))
    rest = each.join(rated, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("r_known"),
        F.sum(F.col("tf") * F.col("base")).alias("r_base"),
        F.sum(F.col("tf") * F.col("code")).alias("r_code"),
    )
    if whole_texts:
        each = added.select("row", F.explode(F.arrays_zip("histories", "times")).alias("h")).select("row", F.col("h.histories").alias("history"), F.col("h.times").alias("times"))
        bytes_left = each.join(codes.select("history", F.col("code").alias("_code")), "history").groupBy("row").agg(F.sum(F.col("times") * F.col("_code")).alias("_left"))
        added = added.join(bytes_left, "row", "left").withColumn("code", F.col("code") + F.coalesce("_left", F.lit(0.0)))
    whole = added.drop("rare", "counts").join(rest, "row", "left").na.fill(0, ["r_known"]).na.fill(0.0, ["r_base", "r_code"])
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("r_known")).cast("bigint").alias("n_known"),
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("r_base")).alias("base_score"),
        (F.col("code") + F.col("r_code")).alias("score"),
    )
