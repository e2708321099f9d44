"""Token ids on disk as directly addressable codes.

An id is cut into 8-bit chunks, low chunk first. Level k holds the k-th chunk of every id that has one; a bitmap beside
it marks the ids that go on in level k + 1, and a rank directory holds the number of marks before every 512th bit. So
the i-th token of a block is read by one look-up per chunk: its place in the next level is the rank of its mark. No other
token is decoded.

The files are Parquet, so that any store Spark reads will do; one row is one block of whole documents::

    part int, block int       writing task and place there; tasks and blocks ascend with doc_id
    first bigint              tokens of the same part before the block
    doc_ids array<bigint>     documents of the block, ascending (null first)
    ends array<bigint>        tokens of the block up to the end of each document
    levels, marks, ranks      array<binary>, one entry per level: chunk bytes, bitmap (low bit first), uint32 directory

Defined cases: a null or empty text has the end id only; rows with equal doc_id stand side by side and keep separate
entries; a null doc_id sorts first; an empty table gives no blocks. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.tokens import batches_by_size, shared_encoder

BLOCK_TOKENS = 1 << 18
RANK_BITS = 512
SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.binary())),
        ("marks", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)
DDL = (
    "part int, block int, first bigint, doc_ids array<bigint>, ends array<bigint>, "
    "levels array<binary>, marks array<binary>, ranks array<binary>"
)


def pack_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of one block."""
    levels, marks, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        levels.append((rest & 255).astype(np.uint8).tobytes())
        marks.append(padded.tobytes())
        ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        rest = rest[more] >> 8
    return levels, marks, ranks


def read_at(levels: list[bytes], marks: list[bytes], ranks: list[bytes], places: np.ndarray) -> np.ndarray:
    """Ids at the given places of a block, in the given order, without decoding any other."""
    places = np.asarray(places, np.int64)
    found, alive = np.zeros(len(places), np.uint32), np.arange(len(places))
    step = RANK_BITS // 8
    for k, (level, mark, rank) in enumerate(zip(levels, marks, ranks, strict=True)):
        found[alive] |= np.frombuffer(level, np.uint8)[places].astype(np.uint32) << np.uint32(8 * k)
        bits = np.frombuffer(mark, np.uint8)
        on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        places, alive = places[on], alive[on]
        if not len(places):
            break
        line = bits.reshape(-1, step)[places // RANK_BITS]
        before = np.clip(places % RANK_BITS - 8 * np.arange(step)[:, None], 0, 8).T  # bits of each byte that count
        inside = np.bitwise_count(line & ((1 << before) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)
        places = np.frombuffer(rank, "<u4")[places // RANK_BITS].astype(np.int64) + inside
    return found


def unpack_codes(levels: list[bytes], marks: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    rest = np.zeros(0, np.uint32)
    for level, mark in zip(reversed(levels), reversed(marks), strict=True):
        own = np.frombuffer(level, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(mark, np.uint8), count=len(own), bitorder="little").view(bool)
        own[more] |= rest << np.uint32(8)
        rest = own
    return rest


def end_with(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text's ids."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def _block_writer(path: str, end_id: int, block_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            levels, marks, ranks = pack_codes(ids)
            row = [part, block, first, [d for h in held for d in h[0]], ends, levels, marks, ranks]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)

        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in batches_by_size(texts, block_tokens):
                ids, lengths = end_with(*encoder.encode(texts[a:b]), end_id)
                held.append((names[a:b], ids, lengths))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
                    block, first, size, held = block + 1, first + size, 0, []
        if held:
            yield flush()

    return write


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode every text and write the ids below ``folder`` in ascending ``doc_id`` order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    ordered.mapInArrow(_block_writer(tokenizer, end_id, block_tokens), DDL).write.parquet(folder)


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of ``folder``."""
    return spark.read.schema(DDL).parquet(folder)


def with_starts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turn ``start`` within a part into the place among all tokens; parts are as many as writing tasks, so few."""
    sizes = blocks.groupBy("part").agg(F.max(F.col("first") + F.element_at("ends", -1)).alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before", "part")


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = unpack_codes(row["levels"], row["marks"]).astype("<u4").tobytes()
            ends = row["ends"]
            starts = [0, *ends[:-1]]
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([row["part"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array([row["first"] + a for a in starts], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
            )


def digests(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: place, number of ids, and crc32 of all ids as little-endian uint32."""
    rows = blocks.mapInArrow(
        _digest_blocks, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return with_starts(rows, blocks).select("doc_id", "start", "n_tokens", "ids_crc32")


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            places = np.array(row["places"], np.int64)
            ids = read_at(row["levels"], row["marks"], row["ranks"], places)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["wanted"], pa.int64()),
                    "place": pa.array(row["at"], pa.int64()),
                    "id": pa.array(ids, pa.int64()),
                }
            )


def tokens_at(blocks: DataFrame, wanted: DataFrame, batch: int = 100_000) -> DataFrame:
    """Ids at places ``(doc_id, place)`` of documents, place counted from 0; places past the end have no row.

    The requests meet the directory (documents and ends) first; only blocks that are asked for are opened, each with
    at most ``batch`` requests per row.
    """
    ends = F.arrays_zip("doc_ids", "ends", F.concat(F.array(F.lit(0).cast("bigint")), F.col("ends")).alias("begins"))
    directory = blocks.select("part", "block", F.explode(ends).alias("e")).where("e.doc_ids is not null")
    directory = directory.select(
        "part", "block", F.col("e.doc_ids").alias("doc_id"), F.col("e.begins").alias("_begin"), F.col("e.ends").alias("_end")
    )
    hits = wanted.select("doc_id", "place").join(directory, "doc_id")
    hits = hits.where((F.col("place") >= 0) & (F.col("_begin") + F.col("place") < F.col("_end")))
    share = F.pmod(F.xxhash64("doc_id", "place"), F.greatest(F.lit(1), F.ceil(F.col("_n") / batch)))
    per_block = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("part", "block")))
    asked = per_block.groupBy("part", "block", share.alias("_share")).agg(
        F.collect_list(F.struct("doc_id", "place", (F.col("_begin") + F.col("place")).alias("p"))).alias("r")
    )
    asked = asked.select(
        "part", "block", F.col("r.doc_id").alias("wanted"), F.col("r.place").alias("at"), F.col("r.p").alias("places")
    )
    opened = asked.join(blocks.select("part", "block", "levels", "marks", "ranks"), ["part", "block"])
    return opened.mapInArrow(_look_up, "doc_id bigint, place bigint, id bigint")
