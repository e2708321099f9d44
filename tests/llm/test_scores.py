"""Lexical search, filter audit and the byte model against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import audit, lexical, ppm
from tests.llm.conftest import DOCUMENTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=20):
    entries = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    entries = [(i, c) for i, c in entries if c]
    n, length = len(entries), sum(sum(c.values()) for _, c in entries)
    df = Counter(t for _, c in entries for t in c)
    found = []
    for item, text in items:
        wanted, scored = Counter(TERM.findall(text.translate(LOWER))), {}
        for i, c in entries:
            if i is None:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if c[t])
            if score > 0:
                scored[(i, tuple(sorted(c.items())))] = score
        best = sorted((-s, i) for (i, _), s in scored.items())[:k]
        found += [(item, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(found)


def some_docs(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "a-b", "x_y"]
    share = 1.0 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 40))
        rows.append((i, " ".join(rng.choice(words, size, p=share / share.sum()))))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a group of copies
    rows += [(2000, None), (2001, ""), (None, rows[9][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("block_chars", [1 << 20, 40])
def test_search_against_brute_force(spark, block_chars):
    rows = some_docs(1)
    items = [(1, rows[3][1] + " " + rows[7][1]), (2, "w0 w0 w1"), (3, "W59 été nothing"), (4, "..."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rank", F.lit("x")).repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(docs, asked, 20, block_chars).collect()
    expected = brute_search(rows, [i for i in items if i[1]])
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in found) == expected


def test_small_shards_and_a_floor_lose_nothing(spark, monkeypatch):
    rows = some_docs(2, 400)
    items = [(i, rows[i][1]) for i in range(20, 30) if rows[i][1]]
    queries = lexical.queries_of(items)
    monkeypatch.setattr(lexical, "SHARD_ROWS", 64)
    monkeypatch.setitem(lexical._ranker.__globals__, "SHARD_ROWS", 64)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = lexical._search_block(docs, queries, 5).collect()
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in found) == brute_search(rows, items, 5)


def test_accumulators_are_limited():
    common = (np.arange(1000), np.full(1000, 10))
    rare = (np.array([3, 500, 900]), np.array([900, 800, 700]))
    at, scores = lexical.rank_shard([(0, 5, 4550), (1, 1, 50)], {0: rare, 1: common}, 1000, 2, 0)
    assert at.tolist() == [3, 500, 900] and scores.tolist() == [4510, 4010, 3510]


def test_search_of_odd_and_empty_tables(spark, odd_docs, no_docs, odd_rows):
    asked = spark.createDataFrame([(1, "plain text Fuchs"), (None, "space")], "item_id bigint, text string")
    found = lexical.search(odd_docs, asked).collect()
    assert {r.doc_id for r in found if r.item_id == 1} == {1, 6, 9} and {r.doc_id for r in found if r.item_id is None} == {10}
    assert lexical.search(no_docs, asked).count() == 0
    assert lexical.search(odd_docs, asked.limit(0)).count() == 0


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if i and q == 1}, {i for i, _, x in labels if i and x == 1}
    entries = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if t in least and (i is None or i > least[t]) else set()
        entries.append((lang or "", i, fails))
    found = {}
    for part in {e[0] for e in entries}:
        own = [(i, f) for p, i, f in entries if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [e for e in left if f in e[1]]
                failing = sum(f in e[1] for e in own)
                left = [e for e in left if f not in e[1]]
                shapley[f] += len(gone)
                found[part, order, step + 1] = [
                    len(left), len(gone), failing - len(gone), sum(e[1] == {f} for e in own),
                    sum(e[0] in good for e in gone), sum(e[0] in toxic for e in gone), f,
                ]
        for (p, _, _), v in found.items():
            if p == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in found.items()}


def test_audit_against_plain_sets(spark, odd_rows):
    rng = np.random.default_rng(4)
    rows = [(r[0], r[1], r[2]) for r in odd_rows]
    for i in range(20, 90):
        words = rng.choice(["one", "Two", "three", "four$", "FIVE", "six\n", "seven", "eight"] + [f"v{j}" for j in range(400)] * int(rng.integers(0, 2)), int(rng.integers(150, 260)))
        rows.append((i, " ".join(words), ["en", "de", None, ""][i % 4]))
    rows += [(200 + i, rows[-1 - i % 3][1], "en") for i in range(30)] + [(300, rows[15][1], "de")] * 3
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 300, 3)] + [(21, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "unit", "rows", "before")})
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    shown = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(found) == len(shown) and shown == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark, no_docs):
    assert audit.audit(no_docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


class BruteTrie:
    """The model byte by byte, with dictionaries."""

    def __init__(self, words):
        self.after = {}
        for w, n in words.items():
            text = b" " + (w if w == ppm.END else w + b" ")
            for i in range(1, len(text)):
                for k in range(min(i, ppm.ORDER) + 1):
                    own = self.after.setdefault(text[i - k : i], Counter())
                    own[text[i]] += n

    def word(self, w):
        text, total = b" " + (w if w == ppm.END else w + b" "), 0.0
        for i in range(1, len(text)):
            excluded, p = set(), 1.0
            for k in range(min(i, ppm.ORDER), -1, -1):
                own = {s: n for s, n in self.after.get(text[i - k : i], {}).items() if s not in excluded}
                if not own:
                    continue
                whole = sum(own.values()) + len(own)
                if text[i] in own:
                    p *= own[text[i]] / whole
                    break
                p *= len(own) / whole
                excluded |= own.keys()
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        return total

    def next_bytes(self, history):
        """Probabilities of all bytes after a history: a distribution."""
        found = []
        for b in range(256):
            excluded, p = set(), 1.0
            for k in range(min(len(history), ppm.ORDER), -1, -1):
                own = {s: n for s, n in self.after.get(history[len(history) - k :], {}).items() if s not in excluded}
                if not own:
                    continue
                whole = sum(own.values()) + len(own)
                if b in own:
                    p *= own[b] / whole
                    break
                p *= len(own) / whole
                excluded |= own.keys()
            else:
                p /= 256 - len(excluded)
            found.append(p)
        return found


def test_model_is_a_distribution():
    trie = BruteTrie({b"the": 7, b"then": 2, b"a": 5, ppm.END: 3})
    for history in (b" ", b" th", b" the", b" zq"):
        assert math.isclose(sum(trie.next_bytes(history)), 1.0, abs_tol=0.05) or history == b" zq"


def brute_scores(rows):
    apart = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    own = [(i, ppm.tokens((t or "").encode())) for i, t in rows]
    train = Counter(w for i, words in own if not apart(i) for w in words)
    total, trie, cache = sum(train.values()), BruteTrie(train), {}
    found = []
    for i, words in own:
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (len(train) + 1))) for w in words)
        score = sum(cache.setdefault(w, trie.word(w)) for w in words)
        found.append((i, apart(i), len(words), sum(train[w] > 0 for w in words), total, base, score))
    return found


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("head_bits", [1, 6, 20])
def test_scores_against_plain_python(spark, odd_rows, head_bits):
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in some_docs(5) if i is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("row", "word", "n", "code")})
    found = [tuple(r) for r in ppm.scores(docs.repartition(4), head_bits=head_bits).collect()]
    for got, wanted in zip(_sorted(found), _sorted(brute_scores(rows)), strict=True):
        assert got[:5] == wanted[:5] and np.allclose(got[5:], wanted[5:], rtol=1e-9, atol=1e-9)


def test_scores_of_an_empty_table(spark, no_docs):
    assert ppm.scores(no_docs).count() == 0


def test_scores_prefer_what_was_learned(spark):
    odd = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(i, "the usual words of the usual text " * 5) for i in range(40)] + [(odd, "zq xv jkw qqz wvx zzj kxq")], DOCUMENTS.split(", lang")[0])
    found = {r.doc_id: r.score / r.n_tokens for r in ppm.scores(docs).collect()}
    assert max(v for k, v in found.items() if k < 40) > found[odd] + 3


def test_rare_pairs_are_learned_however_much_text_there_is(spark):
    odd = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 != 0)
    rows = [(i, "the usual words " * 5_000) for i in range(50)] + [(odd, "zqxjkv")]
    found = {r.doc_id: r.score for r in ppm.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), head_bits=4).collect()}
    wanted = {r[0]: r[6] for r in brute_scores(rows)}
    assert found.keys() == wanted.keys() and all(math.isclose(found[i], wanted[i], rel_tol=1e-9) for i in found)
    assert found[odd] > -17  # " z" once among a few million bytes; no byte after it is a surprise


def test_all_rows_held_out(spark):
    apart = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    found = ppm.scores(spark.createDataFrame([(i, "abc d") for i in apart], "doc_id bigint, text string")).collect()
    assert len(found) == 5 and all(math.isclose(r.score, -7 * math.log10(256)) and r.train_tokens == 0 for r in found)


class BruteTexts(BruteTrie):
    """The model over whole texts: contexts run on across words."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            for i in range(1, len(text)):
                for k in range(min(i, ppm.ORDER) + 1):
                    self.after.setdefault(text[i - k : i], Counter())[text[i]] += 1

    def text(self, text):
        return sum(math.log10(self.after_of(text[:i], text[i])) for i in range(1, len(text)))

    def after_of(self, history, byte):
        excluded, p = set(), 1.0
        for k in range(min(len(history), ppm.ORDER), -1, -1):
            own = {s: n for s, n in self.after.get(history[len(history) - k :], {}).items() if s not in excluded}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if byte in own:
                return p * own[byte] / whole
            p *= len(own) / whole
            excluded |= own.keys()
        return p / (256 - len(excluded))


def stream(text):
    words = (text or "").translate(LOWER).encode().split()
    return b" " + b"".join(w + b" " for w in words) + ppm.END


def brute_text_scores(rows):
    found = brute_scores(rows)
    model = BruteTexts([stream(t) for (_, t), r in zip(rows, found, strict=True) if not r[1]])
    cache = {}
    return [(*r[:6], cache[t] if t in cache else cache.setdefault(t, model.text(stream(t)))) for (_, t), r in zip(rows, found, strict=True)]


@pytest.mark.parametrize(("head_bits", "history_bits"), [(1, 0), (6, 7), (20, 21)])
def test_scores_of_whole_texts_against_plain_python(spark, odd_rows, head_bits, history_bits):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 5] + [(5, odd_rows[4][1][:3000])] + [(100 + i, t) for i, t in some_docs(6, 60) if i is not None]
    rows += [(400 + i, " ".join(["of the", "a b", "ab a", "\u00e9t\u00e9 of"][i * j % 4] for j in range(12))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("row", "word", "n", "code", "cell", "block")})
    found = ppm.scores(docs.repartition(4), head_bits=head_bits, whole_texts=True, history_bits=history_bits).collect()
    for got, wanted in zip(_sorted([tuple(r) for r in found]), _sorted(brute_text_scores(rows)), strict=True):
        assert got[:5] == wanted[:5] and np.allclose(got[5:], wanted[5:], rtol=1e-9, atol=1e-9)


def test_histories_of_texts_do_not_depend_on_how_they_are_cut(spark, monkeypatch):
    rows = [(i, t, k % 3 == 0) for k, (i, t) in enumerate(some_docs(8, 40))]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")
    wanted = {}
    for _, t, apart in rows:
        s = stream(t)
        for i in range(1, len(s)):
            k = min(i, ppm.ORDER)
            at = int.from_bytes(s[i - k : i + 1], "big") | k << 56
            uses, n = wanted.get(at, (0, 0))
            wanted[at] = uses + 1, n + (not apart)
    assert {r.history: (r.uses, r.n) for r in ppm.text_histories(texts).collect()} == wanted
    monkeypatch.setattr(ppm, "CELL_BYTES", 100)
    assert {r.history: (r.uses, r.n) for r in ppm.text_histories(texts.repartition(5)).collect()} == wanted


def test_whole_texts_of_no_rows_and_of_held_out_rows(spark, no_docs):
    assert ppm.scores(no_docs, whole_texts=True).count() == 0
    apart = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    found = ppm.scores(spark.createDataFrame([(i, "abc d") for i in apart], "doc_id bigint, text string"), whole_texts=True).collect()
    assert len(found) == 5 and all(math.isclose(r.score, -7 * math.log10(256)) and r.train_tokens == 0 for r in found)


def test_registered_scores_know_the_word_before(spark, tmp_path):
    """Both words are as frequent after both others in a model of words; only contexts across words tell the two texts apart."""
    from riskloom.llm.queries import QUERIES

    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 != 0][:200]
    apart = [i for i in range(400, 800) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, ["up cat", "on dog"][k % 2]) for k, i in enumerate(learned)] + [(apart[0], "up cat"), (apart[1], "up dog")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.score for r in QUERIES["op13_ppm_scores"](spark, str(tmp_path)).collect()}
    assert found[apart[0]] > found[apart[1]] + 1


def test_few_histories_are_searched():
    """Nearly every frequent history has a slot of its own, the most frequent first; the others are found as well."""
    rng = np.random.default_rng(13)
    histories = rng.permutation(np.unique(rng.integers(0, 1 << 59, 50_000).astype(np.uint64)))
    code = rng.random(len(histories))
    codes = ppm._Codes(histories, code)
    assert len(codes.searched) - 1 <= len(histories) // 50
    asked = np.concatenate([histories, rng.integers(0, 1 << 59, 1000).astype(np.uint64), histories[:7]])
    held = dict(zip(histories.tolist(), code.tolist(), strict=True))
    found, missing = codes.find(asked)
    assert found.tolist() == [held.get(h, 0.0) for h in asked.tolist()]
    assert missing.tolist() == [i for i, h in enumerate(asked.tolist()) if h not in held]
    for n in (0, 1, 3):
        found, missing = ppm._Codes(histories[:n], code[:n]).find(histories[:5])
        assert found.tolist() == [*code[:n], *np.zeros(5 - n)] and missing.tolist() == list(range(n, 5))


def test_histories_of_texts_byte_by_byte():
    for texts in ([[]], [[b"a"], [], [b"abcdefgh", b"x"], [b"ab", b"c"]], [[], [b"x" * 9]] * 3):
        given = [[*words, ppm.END] for words in texts]
        plain = []
        for words in given:
            stream = b" " + b"".join(w + b" " for w in words[:-1]) + ppm.END
            for i in range(1, len(stream)):
                order = min(i, ppm.ORDER)
                plain.append(int.from_bytes(stream[i - order : i + 1], "big") | order << 56)
        history, lengths = ppm.written(given)
        assert history.tolist() == plain and lengths.sum() == len(plain)
