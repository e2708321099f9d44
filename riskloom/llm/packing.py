"""Best-fit packing of token pieces into sequences, by rounds of local packing and merging.

Every task packs its own items best-fit (largest first) into bins. Nearly full bins leave; the underfull ones go on as items of the
next round, the emptier half of them taken apart into their pieces. Bins of small pieces only are full in every task, while other
tasks lack small pieces to fill up large ones; so a task also holds some of those back, an eighth of its items at most. The
next round has as many tasks as its items need, and the last one has one. Where a round leaves nearly as many items as it got,
the next one asks less of a bin that leaves, down to half of its room; two bins below that always merge, so the rounds end.
Each round is written to the shared folder before the next one reads it, so a lost executor cannot mix two different packings.

Defined cases: null and empty texts are one piece of the end id only; repeated rows are packed each on its own; an empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.token_store import end_with
from riskloom.llm.tokens import batches_by_size, shared_encoder

TASK_ITEMS = 100_000
HELD_BACK = 8  # one item in so many may be held back from full bins
NEARLY_FULL = (0.995, 0.98, 0.93, 0.8, 0.5)
STALLED = 0.8  # a round that leaves more of its items makes the next one ask less of a bin
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS_DDL = "done boolean, size int, sequence_id bigint, items binary, sizes binary"


def _cutter(path: str, end_id: int, limit: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in batches_by_size(texts):
                ids, lengths = end_with(*encoder.encode(texts[a:b]), end_id)
                stops = np.cumsum(lengths)
                counts = -(-lengths // limit)
                owner = np.repeat(np.arange(b - a), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = lengths - (counts - 1) * limit  # the first piece takes the remainder
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * limit)
                length = np.where(piece == 0, first[owner], limit)
                raw = ids.astype("<u4").tobytes()
                at = (stops - lengths)[owner] + start
                spans = list(zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True))
                columns = {
                    "doc_id": pa.array([names[a + i] for i in owner], pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in spans], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([raw[x:y] for x, y in spans], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """Ids of every text plus ``end_id``, cut into pieces of ``limit`` where longer; the first piece takes the remainder.

    ``with_ids`` adds the ids themselves as little-endian uint32 bytes.
    """
    ddl = PIECES_DDL + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, end_id, limit, with_ids), ddl)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the members of each bin, given the items' sizes largest first."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with r places left exists
    for item, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, len(bins)
            bins.append([])
        bins[target].append(item)
        if room > size:
            by_room[room - size].append(target)
            rooms |= 1 << (room - size)
    return bins


def _packer(capacity: int, level: int, strictness: int, last: bool):
    full = 0 if last else int(np.ceil(capacity * NEARLY_FULL[strictness]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("size", "items", "sizes")), strict=True)]
        rows.sort(key=lambda row: (-row[0], row[1]))
        closed, under, small = [], [], []
        for members in best_fit([row[0] for row in rows], capacity):
            size = sum(rows[i][0] for i in members)
            bin_ = (size, b"".join(rows[i][1] for i in members), b"".join(rows[i][2] for i in members))
            largest = rows[members[0]][0]  # members come largest first
            if size < full:
                under.append(bin_)
            elif not last and 2 * largest <= capacity:
                small.append((largest, bin_))
            else:
                closed.append(bin_)
        under.sort()
        apart, onward = under[: len(under) // 2], under[len(under) // 2 :]
        room = len(rows) // HELD_BACK
        for _, bin_ in sorted(small):
            pieces = len(bin_[1]) // 8
            if pieces <= room:
                room -= pieces
                apart.append(bin_)
            else:
                closed.append(bin_)
        for _, items, sizes in apart:
            onward += [(int.from_bytes(sizes[4 * i : 4 * i + 4], "little"), items[8 * i : 8 * i + 8], sizes[4 * i : 4 * i + 4]) for i in range(len(items) // 8)]
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        every = [(True, *row) for row in closed] + [(False, *row) for row in onward]
        for a in range(0, len(every), 10_000):
            done, size, items, sizes = zip(*every[a : a + 10_000], strict=True)
            arrays = [
                pa.array(done, pa.bool_()), pa.array(size, pa.int32()), pa.array(base + a + np.arange(len(done)), pa.int64()),
                pa.array(items, pa.binary()), pa.array(sizes, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["done", "size", "sequence_id", "items", "sizes"])

    return pack


def _single_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = np.asarray(batch["item"].to_numpy(zero_copy_only=False), "<i8")
        size = np.asarray(batch["size"].to_numpy(zero_copy_only=False), "<i4")
        yield pa.RecordBatch.from_pydict(
            {
                "size": pa.array(size, pa.int32()),
                "items": pa.array([x.tobytes() for x in item], pa.binary()),
                "sizes": pa.array([x.tobytes() for x in size], pa.binary()),
            }
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = batch["sequence_id"].to_numpy(zero_copy_only=False)
        items = [np.frombuffer(x, "<i8") for x in batch["items"].to_pylist()]
        sizes = [np.frombuffer(x, "<i4").astype(np.int64) for x in batch["sizes"].to_pylist()]
        if not items:
            continue
        yield pa.RecordBatch.from_pydict(
            {
                "item": pa.array(np.concatenate(items), pa.int64()),
                "sequence_id": pa.array(np.repeat(bins, [len(x) for x in items]), pa.int64()),
                "offset": pa.array(np.concatenate([np.cumsum(x) - x for x in sizes]), pa.int64()),
            }
        )


def pack_items(items: DataFrame, capacity: int, task_items: int = TASK_ITEMS) -> DataFrame:
    """Bins of at most ``capacity`` for items ``(item, size)``: item, sequence_id, offset in the bin.

    ``items`` must be stored: it is read once to count and once to pack.
    """
    total = items.where(F.col("size") < capacity).count()
    alone = items.where(F.col("size") >= capacity).select(
        "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    open_bins = items.where(F.col("size") < capacity).mapInArrow(_single_items, "size int, items binary, sizes binary")
    level, strictness, closed = 0, 0, []
    while True:
        tasks = max(1, -(-total // task_items))
        dealt = open_bins.repartition(1) if tasks == 1 else open_bins.repartition(tasks, F.xxhash64("items"))
        packed = stored(dealt.mapInArrow(_packer(capacity, level, strictness, tasks == 1), BINS_DDL), f"bins-{level}")
        closed.append(packed.where("done").select("sequence_id", "items", "sizes"))
        if tasks == 1:
            break
        open_bins = packed.where("not done").select("size", "items", "sizes")
        before, total, level = total, open_bins.count(), level + 1
        strictness = min(strictness + (total > STALLED * before), len(NEARLY_FULL) - 1)
    placed = alone
    for bins in closed:
        placed = placed.unionByName(bins.mapInArrow(_places, "item bigint, sequence_id bigint, offset bigint"))
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset they are packed at."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, with_ids)
    pieces = stored(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(pieces.select("item", F.col("length").cast("int").alias("size")), capacity)
    return pieces.join(placed, "item").drop("item")
