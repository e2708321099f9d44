"""Cached encoding, addressable codes and packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from riskloom.llm import packing, token_store
from riskloom.llm.queries import QUERIES
from riskloom.llm.tokens import Encoder, batches_by_size, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = [
    "a", "É", "ß", " ", " ", "  ", "\n", "\n", ".", "..", "'s", "'", "1", "22", "\t", "\xa0", "\x1c", "漢", "ı", "İ", "Σ", "é", "|",
    "<|endoftext|>", "word", "Über", ", ", "\r\n", "\x85", "😀", "́", "…",
]


@pytest.fixture(scope="module", params=FILES)
def encoder(request):
    return Encoder(tokenizer_path(request.param))


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_library_ids(encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    ids, lengths = encoder.encode(texts)
    stops = np.cumsum(lengths)
    for text, stop, n in zip(texts, stops, lengths, strict=True):
        assert ids[stop - n : stop].tolist() == direct(encoder, text), repr(text)


def test_table_starts_anew_beyond_its_limit(encoder, monkeypatch):
    monkeypatch.setattr("riskloom.llm.tokens.WORD_LIMIT", 50)
    texts = [f"alpha{i} beta{i}, gamma" for i in range(200)]
    got = [encoder.encode([t])[0].tolist() for t in texts]
    assert got == [direct(encoder, t) for t in texts]
    assert len(encoder.numbers) <= 60


def test_batches_cover_all_rows():
    texts = ["x" * 10, None, "y" * 100, "", "z" * 5]
    ranges = batches_by_size(texts, 50)
    assert ranges[0][0] == 0 and ranges[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert batches_by_size([]) == []


@pytest.mark.parametrize("top", [200, 60_000, 1 << 24, (1 << 32) - 1])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    ids = np.concatenate([rng.integers(0, top, 5000), [0, 255, 256, top]]).astype(np.uint32)
    levels, marks, ranks = token_store.pack_codes(ids)
    assert (token_store.unpack_codes(levels, marks) == ids).all()
    places = rng.permutation(len(ids))
    assert (token_store.read_at(levels, marks, ranks, places) == ids[places]).all()


def test_no_ids_make_no_levels():
    assert token_store.pack_codes(np.zeros(0, np.uint32)) == ([], [], [])
    assert len(token_store.unpack_codes([], [])) == 0


def reference_ids(rows, name, end):
    encoder = Encoder(tokenizer_path(name))
    return [(row[0], direct(encoder, row[1]) + [end]) for row in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_against_plain_encoding(spark, odd_docs, odd_rows, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(odd_docs, path, tokenizer_path(FILES[0]), 2, block_tokens=64)
    blocks = token_store.open_tokens(spark, path)
    got = sorted(map(tuple, token_store.digests(blocks).collect()), key=lambda r: r[1])
    expected = reference_ids(odd_rows, FILES[0], 2)
    expected.sort(key=lambda r: (r[0] is not None, r[0]))
    assert [r[0] for r in got] == [r[0] for r in expected]
    assert sorted(r[2:] for r in got) == sorted((len(ids), crc(ids)) for _, ids in expected)
    start = 0
    for row in got:
        assert row[1] == start
        start += row[2]
    by_id = dict(expected)
    asked = [(5, 0), (5, 777), (5, len(by_id[5]) - 1), (5, len(by_id[5])), (9, 3), (2, 0), (99, 0)]
    found = token_store.tokens_at(blocks, spark.createDataFrame(asked, "doc_id bigint, place bigint")).collect()
    assert sorted(map(tuple, found)) == sorted((d, p, by_id[d][p]) for d, p in asked if d in by_id and p < len(by_id[d]))


def test_empty_tables(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_tokens(no_docs, path, tokenizer_path(FILES[0]), 2)
    assert token_store.digests(token_store.open_tokens(spark, path)).count() == 0
    assert packing.pack_documents(no_docs, tokenizer_path(FILES[1]), 0, 64).count() == 0


def check_packing(rows, expected, capacity):
    """Pieces cover every document, and sequences are filled without gaps or overlaps."""
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(sequences)


def test_packing_against_plain_encoding(clashing, odd_rows):
    expected = reference_ids(odd_rows, FILES[1], 0)
    rows = packing.pack_documents(clashing, tokenizer_path(FILES[1]), 0, 64, with_ids=True).collect()
    check_packing(rows, expected, 64)
    pieces = []
    for doc_id, ids in expected:
        first = len(ids) - (len(ids) - 1) // 64 * 64
        starts = [0, *range(first, len(ids), 64)]
        stops = [*starts[1:], len(ids)]
        pieces += [(doc_id, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(starts, stops, strict=True))]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=order) == sorted(pieces, key=order)
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in rows)


def test_best_fit_fills_bins():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(5000)), reverse=True)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= 1.01 * sum(sizes) / 100 + 1


@pytest.mark.parametrize("low,high", [(1, 99), (51, 99), (1, 3)])
def test_rounds_of_merging_lose_nothing(spark, low, high):
    rng = random.Random(high)
    items = [(i, rng.randint(low, high)) for i in range(4000)] + [(4000 + i, 100) for i in range(5)]
    placed = packing.pack_items(spark.createDataFrame(items, "item bigint, size int"), 100, task_items=300).collect()
    assert sorted(r["item"] for r in placed) == list(range(4005))
    size, filled = dict(items), {}
    for r in placed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], size[r["item"]]))
    for spans in filled.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 100
    if low == 1 and high == 99:
        assert len(filled) <= 1.01 * sum(size.values()) / 100 + 2


def test_queries_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = sorted(reference_ids(docs, FILES[0], 2))
    got = sorted(map(tuple, QUERIES["op3_token_store"](spark, folder).collect()))
    start = 0
    for row, (doc_id, ids) in zip(got, expected, strict=True):
        assert row == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    expected = reference_ids(docs, FILES[1], 0)
    rows = QUERIES["op7_best_fit_packing"](spark, folder).collect()
    used = check_packing(rows, expected, 2048)
    assert used <= -(-sum(len(ids) for _, ids in expected) // 2048) + 2
