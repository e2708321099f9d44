"""Whole jobs: nothing is left out for its length, its id or its number of rows."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from riskloom.llm import line_dedup, ngram_join
from riskloom.llm.common import table
from riskloom.llm.ngram_join import Likeness
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_joins import brute_classes, distance, mutate


def brute_lines(rows):
    """(doc_id, text, line number) of every line that repeats, or nearly repeats, an earlier one; no length is left out."""
    lines, seen, gone = [], [], set()
    for doc_id, text, *_ in rows:
        found = enumerate(x.strip(line_dedup.TRIMMED) for x in (text or "").split("\n"))
        lines += [((doc_id is not None, doc_id or 0), doc_id, text, i, x) for i, x in found if x]
    known = set()
    for _, doc_id, text, i, line in sorted(set(lines), key=lambda x: (x[0], x[3])):
        near = lambda x: min(2, len(line) // 12, len(x) // 12)  # noqa: B023, E731
        if line in known or any(abs(len(x) - len(line)) <= near(x) and distance(x, line) <= near(x) for x in seen if near(x)):
            gone.add((doc_id, text, i))
        if line not in known:
            known.add(line)
            seen.append(line)
    return gone


def short_lines():
    rng, rows = random.Random(3), []
    bases = ["".join(rng.choice("abcdefg é") for _ in range(size)).strip() for size in (1, 4, 9, 11, 12, 13, 14, 17, 22, 23, 24, 25, 26, 40)]
    for doc in range(150):
        own = [mutate(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(rng.randint(1, 4))]
        own += ["All rights reserved."] * (doc % 2) + ["All right reserved."] * (doc % 50 == 8) + ["}", ""] * (doc % 3 == 0)
        rng.shuffle(own)
        rows.append((doc, "\n".join(own)))
    return rows


def test_short_lines_are_removed(spark, monkeypatch):
    rows = short_lines()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    expected = {(d, i) for d, _, i in brute_lines(rows)}
    assert {(r["doc_id"], i) for r in line_dedup.removals(docs).collect() for i in r["removed"]} == expected
    monkeypatch.setattr(line_dedup, "PAIR_LINES", 2)  # small: the block search is used
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    assert {(r["doc_id"], i) for r in line_dedup.removals(docs).collect() for i in r["removed"]} == expected


def twofold_ids():
    """Ids that come with two texts; one of them, or both, have near copies under other ids."""
    rng, rows = random.Random(9), []
    for i in range(12):
        a, b = ([f"{n}{i}x{rng.randrange(10**6)}" for _ in range(60)] for n in "ab")
        rows += [(1000 + i, " ".join(a)), (1000 + i, " ".join(b)), (2000 + i, " ".join([*a[:-1], "end"]))]
        if i % 2:
            rows.append((500 + i, " ".join([*b[:-1], "end"])))
    return rows


def test_ids_with_two_texts(spark):
    rows = twofold_ids()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = ngram_join.jaccard_classes(docs, 5, Likeness(80)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows, 5, 80))


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(4)
    a, b, c, d = ([f"{n}{rng.randrange(10**6)}" for _ in range(40)] for n in "abcd")
    texts = [(1, a)] * 50 + [(2, [*a[:-1], "end"])] + [(None, b)] * 20 + [(None, [*b[:-1], "end"])] * 2 + [(None, [*a[:-1], "last"])]
    texts += [(7, c), (7, d), (9, [*c[:-1], "end"]), (3, ["one"])] + [(4, [])] * 2
    rows = [(i, " ".join(words), "en", "s", 1) for i, words in texts]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, None, 7, 7, 3, 4])
    assert {r["text"] for r in got if r["doc_id"] == 7} == {" ".join(c), " ".join(d)}


def test_line_and_copy_stages_by_counts(spark, odd_docs):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id > 20 and length(text) < 20000")
    docs = docs.unionByName(odd_docs.where("length(text) < 20000"))
    first = [tuple(r) for r in docs.collect()]
    second = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(first, docs.schema), "").collect()
    gone, expected = brute_lines(first), Counter()
    for doc_id, text, *_ in first:
        lines = [x for i, x in enumerate(text.split("\n")) if (doc_id, text, i) not in gone]
        if "".join(lines).strip() or len(lines) == len(text.split("\n")):
            expected["\n".join(lines), doc_id] += 1
    assert Counter((r["text"], r["doc_id"]) for r in second) == expected
    third = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(second, docs.schema), "").collect()
    distinct = sorted({(r["doc_id"], r["text"]) for r in second}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    classes = brute_classes([(i, text) for i, (_, text) in enumerate(distinct)], 5, 80)
    assert Counter(r["doc_id"] for r in third) == Counter(distinct[i][0] for i, _, c in classes if c == i)
