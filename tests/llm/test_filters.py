"""Quality rules, language, URLs, shards, mixing, SQL checks and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import language, mixing, quality, sharding, urls
from riskloom.llm.queries import ORACLES, QUERIES, URL_RULES
from riskloom.sources.tables import table
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


# ---- quality


def repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)})


def test_measures_against_plain_python(spark, clashing, odd_rows):
    rng = random.Random(4)
    rows = [(100 + i, " ".join(rng.choice(["a", "b", "c", "#x", "é|"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(clashing.select("doc_id", "text"))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.apply_rules(docs).collect())
    expected = Counter()
    for doc_id, text, *_ in [*rows, *odd_rows]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        symbols, repeats = len(re.findall(r"[#*$%&|<>]", text or "")), repeat_words(words)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        expected[(doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed)] += 1
    assert got == expected


def test_rule_table_decides(spark):
    prose = "the cat and the dog sat on a mat in the sun while it was warm for all of them. " * 4
    prose = " ".join(f"{w}{i if w == 'sat' else ''}" for i, w in enumerate(prose.split()))
    rng = random.Random(1)
    varied = " ".join(f"{w} thing{rng.randrange(999)}" for w in prose.split())
    rows = [(1, varied), (2, " | ".join(varied.split())), (3, " ".join(f"x{i}y" for i in range(80))), (4, None)]
    found = {r["doc_id"]: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1]["kept"] and not found[1]["failed_rules"]
    assert "symbol_ratio" in found[2]["failed_rules"] and not found[2]["kept"]
    assert "stop_words" in found[3]["failed_rules"]
    assert found[4]["base_failed"] and not found[4]["kept"]


def test_quality_is_one_projection(spark):
    plan = quality.apply_rules(table(spark, FOLDER, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_of_no_rows(no_docs):
    assert quality.apply_rules(no_docs).count() == 0


# ---- language


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return language.fit(docs.where(~language.held_out()), sample_docs=2000)


def test_held_out_accuracy(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = docs.where(language.held_out() & F.col("lang").isNotNull())
    judged = language.predict(held, model, keep=["doc_id", "lang"]).collect()
    assert len(judged) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in judged)


def test_mixed_text_is_cut_into_spans(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    parts = {lang: docs.where(F.col("lang") == lang).orderBy(F.desc("n_chars")).first()["text"].split()[:60] for lang in ("de", "fr")}
    text = " ".join([*parts["de"], *parts["fr"], *parts["de"]])
    row = language.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model, spans=True).first()
    assert [s["lang"] for s in row["spans"]] == ["de", "fr", "de"]
    assert abs(row["spans"][0]["words"] - 60) <= 3 and row["lang_pred"] == "de"


def test_scripts_narrow_candidates(spark):
    rows = [("english words and letters of it", "en"), ("ελληνικά γράμματα και λέξεις", "el"), ("русские слова и буквы", "ru")] * 20
    rows = [(f"{t} {i}", lang) for i, (t, lang) in enumerate(rows)]
    fitted = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(1, "и"), (2, "και"), (3, "xyz qqq"), (4, "漢字")]
    got = language.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), fitted).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])][:3] == ["ru", "el", "en"]
    assert all(r["lang_pred"] in ("el", "en", "ru") for r in got)


def test_odd_rows_have_languages(spark, model, clashing, odd_rows, no_docs):
    got = language.predict(clashing, model, spans=True).collect()
    assert len(got) == len(odd_rows)
    found = {r["doc_id"]: r for r in got}
    for doc_id in (2, 3, 7, 8):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"], found[doc_id]["spans"]) == ("und", 0.0, [])
    assert found[9]["lang_pred"] == "de"
    assert language.predict(no_docs, model).count() == 0
    blank = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predict(clashing, blank).collect()} == {"und"}


def test_viterbi_against_plain_search():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 7, 3, 12])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 3
    got, stop = language.viterbi(scores, counts, 2.0), 0
    for n in counts:
        start, stop = stop, stop + n
        own = scores[start:stop]
        best = {(): 0.0}
        paths = [((), 0.0)]
        for row in own:
            ends = {}
            for path, value in paths:
                for k in range(3):
                    new = value + row[k] - (2.0 if path and path[-1] != k else 0.0)
                    if new > ends.get(k, ((), -math.inf))[1]:
                        ends[k] = ((*path, k), new)
            paths = list(ends.values())
        best = max(paths, key=lambda p: p[1])[0]
        assert tuple(got[start:stop]) == best


# ---- urls

RULES = {r.text: r.verdict for r in URL_RULES}


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        t for t in RULES
        if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])
    ]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/x", "http://a.Example.ORG/es/1?u=/fr/", "x://example.org/es", "http://e.com/fr/",
    "http://morg/x", "http://com/de/1#f", "https://a.com/de?x", "a://b://c.org/d", "http://example.org", "http://h.org?x/y",
    "http://É.org/ü", "http://a.com/de/\n/b", "http://a.net/" + "s/" * 300, "http://example.org/en/17", "http://example.org/en/27",
]


def test_rules_against_plain_python(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, "http://e.com/fr/")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, shape string, purity string")
    got = urls.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for page_id, url in rows:
        r, (host, path, rule) = by_id[page_id], plain_rule(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] in ("allow", "block")
        if rule:
            assert r["verdict"] == RULES[rule]


def test_templates_learn_from_labels(spark):
    rows = [f"http://s{i % 7}.com/de/{i}" for i in range(200)] + [f"http://s{i % 7}.com/fr/{i}.html" for i in range(200)]
    rows += [f"http://new.net/de/{i}" for i in range(30)] + [f"http://new.net/fr/{i}.html" for i in range(30)]
    rows += [f"http://slugs.net/{chr(97 + i % 26)}{i}zz/page" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = urls.judge_urls(pages, URL_RULES)
    found = {(r["host"], r["template"]): r["verdict"] for r in got.where("host like '%.net'").collect()}
    assert found[("new.net", "/de/{n}")] == "block" and found[("new.net", "/fr/{n}.html")] == "allow"
    assert ("slugs.net", "/*/page") in found and len(found) == 3


def test_no_pages(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).count() == 0


# ---- shards


def test_matrix_has_its_margins():
    cells, shards = [5, 0, 17, 100, 1], sharding.even_sizes(123, 7)
    matrix = sharding.communication_matrix(cells, shards, 3)
    assert [sum(r) for r in matrix] == cells and [sum(c) for c in zip(*matrix, strict=True)] == shards
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def test_hypergeometric_draws_follow_the_law():
    rng = random.Random(0)
    draws = Counter(sharding.draw_hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        expected = 20_000 * math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(draws[k] - expected) < 5 * math.sqrt(expected) + 5
    assert sharding.draw_hypergeometric(rng, 10**9, 10**9, 10**6) == pytest.approx(500_000, abs=5000)


def shards_of(df, n, ids, seed):
    return sharding.shuffle_into_shards(df, n, ids, seed).collect()


def check_shards(rows, n, total):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(n)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_even_and_uniform(spark):
    df = spark.range(4003).withColumnRenamed("id", "doc_id")
    first, again, other = (shards_of(df, 24, ["doc_id"], seed) for seed in (1, 1, 2))
    check_shards(first, 24, 4003)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) != sorted(map(tuple, other))
    # neighbours meet as often as chance says
    shard = {r["doc_id"]: r["shard"] for r in first}
    same = sum(shard[i] == shard[i + 1] for i in range(4002))
    assert abs(same - 4002 / 24) < 6 * math.sqrt(4002 / 24)


def test_odd_rows_have_shards(clashing, odd_rows, no_docs):
    rows = shards_of(clashing, 4, ["doc_id", "text"], 0)
    check_shards(rows, 4, len(odd_rows))
    assert shards_of(no_docs, 4, ["doc_id"], 0) == []


def test_hot_rows_spread_over_cells(spark):
    """One row without an id that stands 20,000 times, and 3,000 texts of one id."""
    rows = [(None, "same")] * 20_000 + [(7, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    first, again = (shards_of(df.repartition(n), 24, ["doc_id", "text"], 3) for n in (5, 11))
    check_shards(first, 24, 23_000)
    assert Counter(first) == Counter(again)
    hot = [r for r in first if r["doc_id"] is None]
    per_shard = Counter(r["shard"] for r in hot)
    assert len(hot) == 20_000 and len(per_shard) == 24 and max(per_shard.values()) < 1.1 * 20_000 / 24
    # within a shard the copies stand among the others: no half of the slots holds far more of them
    early = sum(r["slot"] < 23_000 // 48 for r in hot)
    assert 9_500 < early < 10_500


def test_shard_query_columns(spark):
    rows = QUERIES["op10_uniform_shards"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    check_shards(rows, 24, len(texts))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


# ---- mixing


def counted_rows(rng, sizes):
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) + i, source, rng.randint(0, 50)) for i in range(n)]
    return rows


def plain_weights(tokens, target):
    total = sum(tokens.values())
    shares = {s: t / total for s, t in tokens.items() if t}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repeats(a):
        w = weights(a)
        budget = target.budget or max(tokens[s] / w[s] for s in w)
        return max(w[s] * budget / tokens[s] for s in w)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= target.evenness * math.log(len(shares)) else (low, mid)
    even, low, high = low, 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= target.repetitions else (mid, high)
    chosen = weights(max(even, high if repeats(0.0) > target.repetitions else 0.0))
    return chosen, target.budget or max(tokens[s] / chosen[s] for s in chosen)


@pytest.mark.parametrize("target", [mixing.Target(0.9, 100.0), mixing.Target(1.0, 2.5), mixing.Target(0.8, 50.0, 4000.0)])
def test_mixture_against_plain_python(spark, monkeypatch, target):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    rows = counted_rows(random.Random(2), {"a": 200, "b": 40, None: 25, "d": 3, "silent": 0}) + [(9001, "silent", 0), (9002, "a", 5), (9002, "a", 5)]
    counted = mixing.merged(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("identity", F.xxhash64("doc_id")))
    plan = mixing.mixing_plan(counted, target, 3)
    tokens = Counter()
    for _, source, n in rows:
        tokens[source] += n
    weights, budget = plain_weights(tokens, target)
    for r in plan.collect():
        assert r["weight"] == pytest.approx(weights.get(r["source"], 0.0), abs=1e-6)
    given = mixing.mixed_sequence(counted, plan, 500, 3).collect()
    streams = {}
    for r in given:
        streams.setdefault(r["source"], []).append((r["start"], r["copy"], r["tokens"], r["doc_id"], r["block"]))
    assert [x[3] for x in streams["silent"]] == [9001]
    for source, weight in weights.items():
        own = sorted(streams[source], key=lambda x: (x[0], x[2]))
        quota, at = weight * budget, 0
        for start, _copy, n, _, block in own:
            assert start == at and block == math.floor(start / (weight * 500) + 1e-9) or abs(start / (weight * 500) - block) < 1 + 1e-6
            at += n
        assert at >= quota * (1 - 1e-4) - 1e-6 and own[-1][0] <= quota * (1 + 1e-4)
        whole = int(quota / tokens[source] + 1e-6)
        times = Counter(x[3] for x in own)
        assert all(whole <= times[d] / Counter(r[0] for r in rows)[d] <= whole + 1 for d in {r[0] for r in rows if r[1] == source and r[2]})


@pytest.mark.parametrize("lot", [16, 4096])
def test_hot_rows_do_not_overshoot(spark, monkeypatch, lot):
    """Equal rows, and rows of one or no id with different texts: a quota is met to one document in both forms."""
    monkeypatch.setattr(mixing, "LOT_ROWS", lot)
    rows = [(None, "the very same words", "hot")] * 700 + [(None, f"some other text {i}", "many") for i in range(500)]
    rows += [(5, f"one id and text {i}", "one") for i in range(300)] + [(i, "five words in a row", "rest") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counted = mixing.token_counts(docs)
    assert counted.where("source = 'hot'").count() == 1
    target = mixing.Target(0.97, 50.0, 9000.0)
    plan = mixing.mixing_plan(counted, target, 3)
    quota = {r["source"]: r["quota"] for r in plan.collect()}
    given, streams = mixing.mixed_sequence(counted, plan, 500, 3).collect(), {}
    for r in given:
        streams.setdefault(r["source"], []).append((r["start"], r["tokens"]))
    assert len({(r["source"], r["start"]) for r in given}) == len(given) == len({r["place"] for r in given})
    texts = mixing.mixed_documents(docs, target, 3).collect()
    number = Counter(r["source"] for r in texts)
    for source, own in streams.items():
        own.sort()
        ends = [start + n for start, n in own]
        assert [s for s, _ in own] == [0, *ends[:-1]] and quota[source] <= ends[-1] + 1e-3 < quota[source] + own[-1][1] + 1e-2
        assert number[source] == len(own)
    passes = Counter((r["source"], r["text"]) for r in texts if r["source"] in ("many", "one"))
    for source in ("many", "one"):
        assert max(n for (s, _), n in passes.items() if s == source) <= min((n for (s, _), n in passes.items() if s == source)) + 1


def test_mixed_documents_keep_their_columns(clashing, odd_rows, no_docs, spark):
    target = mixing.Target(0.95, 3.0)
    mixed = mixing.mixed_documents(clashing, target, 1)
    assert mixed.columns == clashing.columns
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert all(got[r[0]] >= 1 for r in odd_rows) and max(got.values()) <= 8
    assert mixing.mixed_documents(no_docs, target).count() == 0


# ---- pipeline


def test_pipeline_against_plain_steps(spark, odd_docs):
    """Stage results held against plain Python where their method allows, on the small table with odd rows added."""
    import corpus_pipeline
    from tests.llm.test_joins import brute_classes
    from tests.llm.test_whole import brute_lines

    docs = table(spark, FOLDER, "documents").where("doc_id > 20").unionByName(odd_docs)
    before = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "ngram_join", "mixing", "packing"]
    first = corpus_pipeline.identify_language(spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in first} == {2, 3, 7, 8}
    docs = spark.createDataFrame(first, docs.schema)
    second = corpus_pipeline.drop_repeated_lines(spark, docs, FOLDER).collect()
    rows = [(r["doc_id"], r["text"]) for r in first if r["doc_id"] != 5]
    gone = brute_lines([r for r in rows if len(r[1]) < 20_000])
    kept = {r["doc_id"]: r["text"] for r in second}
    for doc_id, text in rows:
        lines = [x for i, x in enumerate(text.split("\n")) if (doc_id, text, i) not in gone]
        if len(text) < 20_000:
            assert kept.get(doc_id, "") == ("\n".join(lines) if "".join(lines).strip() else "")
    docs = spark.createDataFrame(second, docs.schema)
    third = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in second], 5, 80)
    assert {r["doc_id"] for r in third} == {d for d, _, c in classes if c == d or d is None}
    docs = spark.createDataFrame(third, docs.schema)
    fourth = corpus_pipeline.mix_sources(spark, docs, FOLDER)
    assert {tuple(r) for r in fourth.collect()} == {tuple(r) for r in third}
    last = corpus_pipeline.pack_sequences(spark, fourth, FOLDER).collect()
    pieces, filled = Counter(r["doc_id"] for r in fourth.collect()), Counter()
    assert {r["doc_id"] for r in last} == set(pieces)
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == pieces
    for r in last:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 2


def test_pipeline_run_has_rows(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
