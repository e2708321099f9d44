"""The registered queries of this subpackage, with the SQL each one is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import audit, language, lexical, line_dedup, mixing, ngram_join, packing, ppm, quality, sharding, token_store, topk, urls
from riskloom.llm.common import documents, shared_dir, stored, table
from riskloom.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, t, w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(w, [{stop}]))::BIGINT AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alphabetic_words,
    len(list_distinct(w))::BIGINT AS n_distinct_words,
    len(list_filter(l, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•', '‣', '◦')))::BIGINT AS n_bullet_lines,
    len(list_filter(l, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…')))::BIGINT AS n_ellipsis_lines
  FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols,
    CASE WHEN n_words > 0 THEN n_alphabetic_words / n_words ELSE 0 END AS alphabetic,
    CASE WHEN n_words > 0 THEN n_distinct_words / (sqrt(n_words) * sqrt(least(n_words, 100))) ELSE 0 END AS distinct_words,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup,
    CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END AS bullets,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipses
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND mean_word_length BETWEEN 2 AND 12 AND symbols <= 0.1 AND n_stop_words >= 2 AND alphabetic >= 0.7
    AND dup <= 0.3 AND bullets <= 0.9 AND ellipses <= 0.3 AND distinct_words >= 0.05 AS kept
FROM rated
""".replace("{stop}", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.apply_rules(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_token_store")
def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every document's ids, read back from the files they were written to."""
    docs = documents(spark, folder)
    path = shared_dir(spark, "tokens")
    token_store.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.digests(token_store.open_tokens(spark, path))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op4_language_spans")
def op4_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; three quarters of the ids may be learned from."""
    docs = documents(spark, folder)
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model, keep=["doc_id"]).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


URL_RULES = (
    urls.UrlRule("allow", "org/"),
    urls.UrlRule("block", "example.org/es/"),
    urls.UrlRule("block", "example.org/en/1"),
    urls.UrlRule("allow", "com/fr/"),
    urls.UrlRule("block", "com/de/"),
)


@query("op6_url_templates")
def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query("op10_uniform_shards")
def op10_uniform_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document under the ``rows`` law."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, folder).select(
        "doc_id", (F.length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shuffle_into_shards(rows, 24, ["doc_id", "text_crc32", "size"], seed=10)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.c, x.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


@query("op9_pivot_top_k", OP9_SQL)
def op9_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 rows of largest inner product for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY doc_id
), reps AS (
  SELECT m, min(doc_id) AS rep FROM sets GROUP BY m
), r AS (
  SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) WHERE s.doc_id IN (SELECT rep FROM reps)
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT rep AS x, rep AS y FROM reps UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x
), label AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(label.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (m)
LEFT JOIN label ON label.x = reps.rep
"""


@query("op8_ngram_jaccard", OP8_SQL)
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Size and class of every document at three words and a similarity of 0.9."""
    return ngram_join.jaccard_classes(documents(spark, folder), 3, ngram_join.Likeness(90))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines taken out of every document: the same or a near line stands earlier."""
    return line_dedup.removals(documents(spark, folder))


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of all documents: 95 % of the greatest entropy, four passes over a source at most."""
    counted = stored(mixing.token_counts(documents(spark, folder)), "token-counts")
    plan = mixing.mixing_plan(counted, mixing.Target(evenness=0.95, repetitions=4.0), seed=5)
    return mixing.mixed_sequence(counted, plan, block_tokens=1 << 20, seed=5)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), k
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), k GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(documents(spark, folder), table(spark, folder, "benchmark"), 20)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
  SELECT t, min(doc_id) AS least_id FROM t GROUP BY t
), m AS (
  SELECT part, doc_id,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t.t, '[A-Z]')) > 3 * length(t.t))::INT
    + 8 * regexp_matches(t.t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least_id, false)::INT AS mask
  FROM t JOIN least USING (t)
), n AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL
), one AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS one(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM one a JOIN one b ON b.f <> a.f JOIN one c ON c.f NOT IN (a.f, b.f) JOIN one d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN one e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) r(i)
), found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters keep, remove and lose, in all their orders."""
    return audit.audit(documents(spark, folder), table(spark, folder, "labels"))


@query("op13_ppm_scores")
def op13_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document under a byte model and under word frequencies."""
    return ppm.scores(documents(spark, folder), whole_texts=True)
