"""Joins, searches and line removal against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import line_dedup, ngram_join, topk
from riskloom.llm.ngram_join import Likeness, Zones, list_keys, subset_keys
from riskloom.llm.shingles import Shingler

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def word_sets(rows, size):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= size:
            sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
        else:
            sets.append({tuple(words)} if words else set())
    return sets


def brute_classes(rows, size, part):
    """Smallest doc_id reachable by links, by plain search."""
    sets = word_sets(rows, size)
    label = {row[0]: row[0] for row in rows if row[0] is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= part * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                label[max(x, y)] = min(x, y)
    return [(row[0], len(s), None if row[0] is None else root(row[0])) for row, s in zip(rows, sets, strict=True)]


def family(rng, first, base, count, edits):
    """Texts made from ``base`` by replacing a few words each."""
    rows = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
        rows.append((first + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def texts():
    """Groups of near copies of many sizes, one large group, a passage shared by a third, exact copies, short texts."""
    rng, rows = random.Random(8), []
    for size in (4, 9, 10, 11, 12, 18, 20, 22, 30, 45, 80, 200, 600):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        rows += family(rng, len(rows) + 1, base, 9, max(1, size // 60))
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    rows += family(rng, len(rows) + 1, base, 120, 9)
    passage = [f"p{i}" for i in range(50)]
    for _ in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(10, 30))]
        rows.append((len(rows) + 1, " ".join([*passage, *own])))
    rows += [(len(rows) + 1 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(len(rows) + 1 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "one two", "ONE\ttwo", "two one"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,part", [(3, 90), (5, 80), (1, 70)])
def test_classes_against_brute_force(spark, texts, monkeypatch, size, part):
    monkeypatch.setattr(ngram_join, "PAIR_LIST", 6)  # so that the block search is used as well
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    got = ngram_join.jaccard_classes(docs, size, Likeness(part)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(texts, size, part))


def test_odd_rows_have_classes(clashing, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = ngram_join.jaccard_classes(clashing, 3, Likeness(90)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows, 3, 90), key=key)
    assert ngram_join.jaccard_classes(no_docs, 3, Likeness(90)).count() == 0


@pytest.mark.parametrize("part", [50, 80, 90, 100])
def test_linked_sets_always_meet(part):
    like, rng = Likeness(part), np.random.default_rng(part)
    boundary = 14
    zones = Zones(like, boundary)
    for _ in range(1500):
        size = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, 3)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not like.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        keys = []
        for s in (a, b):
            own = [subset_keys(s, like)] if len(s) < boundary else []
            keys.append(set(np.concatenate(own + ([list_keys(s, zones)] if len(s) >= zones.starts[0] else [])).tolist()))
        assert keys[0] & keys[1], (len(a), len(b))


def test_shingles_from_bytes():
    texts = ["", "A b\tC", "ÀB àb x  y", "one", "a\x0bb\x0cc d", "x" * 5000 + " y z", "the The THE the the the"]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for size in (1, 3, 5):
        found = [len(s) for s in Shingler(size).sets(np.frombuffer(data, np.uint8), ends)]
        assert found == [len(s) for s in word_sets([(0, t) for t in texts], size)]


# ---- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(line) + 1)
        if kind == 0:
            line.insert(at, rng.choice("abcé漢"))
        elif at < len(line):
            line[at : at + 1] = [] if kind == 1 else [rng.choice("abcé漢")]
    return "".join(line)


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_automaton_against_dynamic_programming(edits, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELLS", 500)
    rng, left, right = random.Random(edits), [], []
    for _ in range(600):
        line = "".join(rng.choice("abcé漢 ") for _ in range(rng.randint(0, 40)))
        left.append(line)
        right.append(mutate(rng, line, rng.randint(0, edits + 2)))
    expected = [distance(a, b) <= edits for a, b in zip(left, right, strict=True)]
    assert line_dedup.within_edits(left, right, edits).tolist() == expected


def brute_removed(rows, min_chars, edits):
    lines, seen = [], {}
    for doc_id, text, *_ in rows:
        if text is not None:
            lines += [((doc_id is not None, doc_id or 0), text, i, x.strip(line_dedup.TRIMMED)) for i, x in enumerate(text.split("\n"))]
    lines = sorted({x for x in lines if len(x[3]) >= min_chars}, key=lambda x: (x[0], x[2]))
    gone = set()
    for key, text, i, line in lines:
        if line in seen:
            gone.add((key[1] if key[0] else None, text, i))
            continue
        if any(abs(len(x) - len(line)) <= edits and distance(x, line) <= edits for x in seen):
            gone.add((key[1] if key[0] else None, text, i))
        seen[line] = True
    return gone


@pytest.fixture(scope="module")
def lined():
    rng, rows = random.Random(5), []
    bases = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(12, 60))).strip() for _ in range(25)]
    hot = "a line that very many documents share between them"
    for doc in range(160):
        own = [mutate(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(rng.randint(1, 4))]
        own += [hot] * (doc % 3 == 0) + [hot[:20] + rng.choice("xyz") + hot[20:]] * (doc % 7 == 0) + ["short"] * (doc % 2)
        rng.shuffle(own)
        rows.append((doc, "\n".join(own)))
    return rows


@pytest.mark.parametrize("edits,pair_lines", [(2, 24), (1, 2), (2, 2), (0, 24)])
def test_removed_lines_against_brute_force(spark, lined, monkeypatch, edits, pair_lines):
    monkeypatch.setattr(line_dedup, "PAIR_LINES", pair_lines)  # small: the block search is used
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    docs = spark.createDataFrame(lined, "doc_id bigint, text string").repartition(4)
    got = {(r["doc_id"], i) for r in line_dedup.removals(docs, 10, edits).collect() for i in r["removed"]}
    assert got == {(d, i) for d, _, i in brute_removed(lined, 10, edits)}


def test_texts_without_repeats(spark, lined):
    docs = spark.createDataFrame([(*r, len(r[1]), "x") for r in lined], "doc_id bigint, text string, n_chars bigint, removed string")
    gone, expected = brute_removed(lined, 10, 2), {}
    for doc_id, text in lined:
        kept = [x for i, x in enumerate(text.split("\n")) if (doc_id, text, i) not in gone]
        if "".join(kept).strip():
            expected[doc_id] = "\n".join(kept)
    got = line_dedup.without_repeats(docs, 10, 2, "n_chars").collect()
    assert {r["doc_id"]: r["text"] for r in got} == expected
    assert all(r["n_chars"] == len(r["text"]) and r["removed"] == "x" for r in got)


def test_odd_rows_of_lines(clashing, odd_rows, no_docs):
    got = line_dedup.removals(clashing).collect()
    assert len(got) == len(odd_rows)
    removed = {(r["doc_id"], r["n_removed"]) for r in got}
    assert removed == {(1, 0), (2, 0), (3, 0), (None, 0), (5, 0), (6, 1), (7, 0), (8, 0), (9, 0), (10, 0)}
    kept = line_dedup.without_repeats(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(odd_rows) - 2
    assert line_dedup.removals(no_docs).count() == 0


# ---- top k


def brute_top(rows, step, k):
    vectors = {}
    for vec_id, x in rows:
        if vec_id is not None and x and all(v is not None and np.isfinite(v) for v in x):
            vectors[vec_id] = np.pad(np.floor(64 * np.array(x, np.float32).astype(float)).astype(int), (0, 8 - len(x)))
    found = []
    for q in sorted(v for v in vectors if v % step == 0):
        best = sorted((-int(vectors[q] @ vectors[x]), x) for x in vectors if x != q)[:k]
        found += [(q, i + 1, x, -s) for i, (s, x) in enumerate(best)]
    return found


@pytest.mark.parametrize("chunk", [1024, 16])
def test_top_k_with_ties_copies_and_bad_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 6] + rng.normal(size=8) * 0.1]) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(200)]  # a large group of copies
    rows += [(700 + i, [0.0] * 8) for i in range(40)] + [(800, [1.0, 2.0]), (801, None), (802, []), (803, [float("nan")] * 8)]
    rows += [(804, [float("inf")] + [0.0] * 7), (805, [None] * 8), (None, rows[0][1]), rows[7]]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string").repartition(3)
    got = topk.top_k(vectors, F.col("vec_id") % 5 == 0, 10).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 10)


@pytest.mark.parametrize("scale", [0.5, 2, 400, 1e6])
def test_top_k_in_integers_of_each_width(spark, monkeypatch, scale):
    for name, value in {"CHUNK": 16, "LOT": 7, "SLABS": 9, "FIRST_ROUNDS": (1, 2, 4, 8), "REST": 1}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in np.clip(rng.normal(size=8), -1, 1) * scale]) for i in range(900)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 7 == 0, 6).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 7, 6)


def test_narrowest_integers():
    assert [topk._kind(-2.0, x) for x in (1.99, 2.0, 511.99, 512.0, 3e7, 4e7)] == ["<i1", "<i2", "<i2", "<i4", "<i4", "<i8"]
    assert [topk._kind(x, 0.0) for x in (-2.0, -2.01, -512.0, -513.0)] == ["<i1", "<i2", "<i2", "<i4"]


def test_search_among_equal_scores():
    rng = np.random.default_rng(6)
    queries, rows = (rng.integers(-2, 3, (n, 2)).astype("<i1") for n in (9, 5000))
    names, marks, runs = rng.permutation(5000), rng.random((9, 3)) < 0.7, [3000, 10, 1990]
    least = np.where(np.arange(9) % 3 == 0, 4, topk.LEAST)
    own = np.repeat(marks, runs, axis=1)
    expected = set()
    for q in range(9):
        scores = rows.astype(int) @ queries[q].astype(int)
        best = sorted((-s, n) for s, n, there in zip(scores, names, own[q], strict=True) if there and s >= least[q])[:4]
        expected |= {(q, n, -s) for s, n in best}
    q, x, scores = topk._search(queries, rows, range(3), runs, marks, least, names, 4)
    assert len(q) == len(expected) and set(zip(q, names[x], scores, strict=True)) == expected


def test_lots_of_queries_are_not_broadcast(spark, monkeypatch):
    """The planner knows the table of queries only, of which each slab gets a part: lots of any size would go through the driver."""
    plans, store = [], topk.stored

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(topk, "stored", spy)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 5 == 0, 3).count() == 180
    joins = [plan for name, plan in plans if name in ("best", "queries", "visits") and "Join" in plan]
    assert len(joins) > 2 and not any("Broadcast" in plan for plan in joins)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True), 5).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert topk.top_k(one, F.lit(True), 5).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5])], schema)
    got = [tuple(r) for r in topk.top_k(three, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 2, -4096)]


def test_only_sets_of_pairs_left_over_are_taken_along(spark):
    """Sets are wide: those in no pair that the sketches leave over stay where they are, and none of a pair is lost."""
    sets = spark.range(5000).select(F.col("id").alias("node"), F.lit(b"x" * 100).alias("members"))
    pairs = spark.createDataFrame([(3, 4000), (4000, 17), (3, 17)], "a bigint, b bigint")
    taken = {r.node for r in ngram_join._wanted(sets, pairs).collect()}
    assert {3, 17, 4000} <= taken and len(taken) < 50


def test_sketches_take_a_bit_or_two_a_member():
    rng = np.random.default_rng(11)
    for size in (10, 1000, 5000):
        one, two = (np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(2))
        near = np.unique(np.concatenate([one[: size * 9 // 10], two[: size // 10]]))
        a, b, c = map(ngram_join.sketch, (one, two, near))
        assert 8 * len(a) <= max(1024, 2 * size)
        like = ngram_join.Likeness(80)
        assert ngram_join.apart(a, c) <= len(np.setxor1d(one, near))
        assert ngram_join.apart(a, b) > like.differing(len(one), len(two))


def test_only_sets_of_pairs_left_over_are_stored(spark, monkeypatch):
    """Members of sets that share a list, but are in no pair that the sketches leave over, are written nowhere."""
    tables = []

    def stored(df, name, plain=ngram_join.stored):
        tables.append(plain(df, name))
        return tables[-1]

    monkeypatch.setattr(ngram_join, "stored", stored)
    rng = random.Random(5)
    # every two texts begin alike, so that they share lists, and have half of their words in common
    halves = [" ".join(f"h{k}x{rng.randrange(10**6)}" for _ in range(60)) for k in range(40)]
    rows = [(2 * k + i, f"{half} " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(60))) for k, half in enumerate(halves) for i in range(2)]
    rows += [(500, rows[0][1] + " end"), (500, rows[0][1] + " end"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: (r[0] is not None, r[0] or 0)
    # sets of a node: which lists strangers share depends on hashes, so one list for all is given
    monkeypatch.setattr(ngram_join, "list_keys", lambda shingles, zones: np.array([1], np.uint64))
    got = ngram_join.jaccard_classes(docs, 3, Likeness(90)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows, 3, 90), key=key)
    wide = [t.select("node").distinct().count() for t in tables if "members" in t.columns]
    assert wide and max(wide) <= 4
