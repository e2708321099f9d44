"""Language identification of mixed-language texts.

Every word has a score per language from its letter pairs and triples. The scripts of its letters narrow the candidates
first: a word in Greek letters is only held against languages seen in Greek letters. A Viterbi path over the words, with
a penalty for every switch, then labels spans; the language with most letters is the document's, its share the score.

The model is fitted on a bounded sample of labelled texts (``sample_docs`` in all, dealt evenly to the languages, chosen
by a hash of the text, each distinct text once) and holds ``2 ** BUCKET_BITS`` numbers per language.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and no spans, and so is everything when
there is nothing to learn from; equal shares go to the first language in alphabetical order; repeated rows each get the same
result; rows without ``lang`` are not learned from. Input columns with the names of new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from riskloom.llm.tokens import release_encoders, text_ranges

BUCKET_BITS = 15
WORD_LIMIT, CHAR_LIMIT = 250_000, 1 << 22  # scored words kept per task, and their characters; beyond them the table starts anew
BATCH_CHARS = 1 << 20
SWITCH_PENALTY = 12.0
UNKNOWN = "und"
# Where a script's range of code points begins, up to the next entry; "" is no particular script.
SCRIPT_STARTS = [
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00C0, "Latin"), (0x0250, ""),
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"), (0x1800, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"),
    (0x3190, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""),
    (0x20000, "Han"), (0x30000, ""),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept apart from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, log score per bucket and language, and which scripts each is written in."""

    languages: list[str]
    scores: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages


def letters_of(word: str) -> str:
    """The letters of a word in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def gram_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every letter pair and triple of non-empty words; a word's edges count as a letter."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    edge = codes == 0
    owner = np.cumsum(edge) - 1
    low, high = codes * np.uint64(0x9E3779B97F4A7C15), codes * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = low[:-1] ^ (high[1:] >> np.uint64(7))
    triples = pairs[:-1] * np.uint64(0xFF51AFD7ED558CCD) + low[2:]
    inner = ~edge[1:-1]  # a triple belongs to the word of its middle letter
    keys = np.concatenate([pairs * np.uint64(0xD6E8FEB86659FD93), triples[inner]])
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    # the pair that closes a word starts at its last letter, the pair that opens one at the edge before it
    owners = np.concatenate([owner[:-1], owner[1:-1][inner]])
    return (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owners


def script_numbers(words: Sequence[str]) -> np.ndarray:
    """Script of each non-empty word: that of its first letter."""
    codes = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT_OF[np.searchsorted(_STARTS, codes, side="right") - 1]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    size = 1 << BUCKET_BITS
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = [w for w in map(letters_of, text.split()) if w]
            if not words:
                continue
            own = counts.setdefault(lang, np.zeros(size + len(SCRIPTS), np.int64))
            own[:size] += np.bincount(gram_buckets(words)[0], minlength=size)
            own[size:] += np.bincount(script_numbers(words), minlength=len(SCRIPTS))
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(used)), "bucket": pa.array(used, pa.int32()), "n": pa.array(own[used], pa.int64())}
        )


def fit(labelled: DataFrame, sample_docs: int = 8_000, script_share: float = 0.01) -> Model:
    """Learn from ``(text, lang)`` rows where both are given."""
    given = labelled.select("text", "lang").where("lang is not null")
    # one number per language comes to the driver, as the model itself does, so that no text is dealt out by language;
    # copies count once, so a language of few texts with many copies keeps its share of the sample
    distinct = given.where("text is not null").select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, sample_docs / len(counts) / n)]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = given.where("text is not null").where(place < share).select("lang", "text").dropDuplicates()
    grams = chosen.mapInArrow(_count_grams, "lang string, bucket int, n bigint")
    # at most (buckets + scripts) rows per language
    rows = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    table = np.zeros(((1 << BUCKET_BITS) + len(SCRIPTS), len(names)))
    place_of = {name: i for i, name in enumerate(names)}
    table[rows["bucket"].to_numpy(), [place_of[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    grams_seen, scripts_seen = table[: 1 << BUCKET_BITS], table[1 << BUCKET_BITS :]
    scores = np.log(grams_seen + 0.5) - np.log(grams_seen.sum(axis=0) + 0.5 * len(grams_seen))
    allowed = scripts_seen >= script_share * np.maximum(scripts_seen.sum(axis=0), 1)
    return Model(names, (scores - scores.mean(axis=1, keepdims=True)).astype(np.float32), allowed & (scripts_seen > 0))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Scores and letter counts of distinct words under a model; one per task."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.numbers = _Words()
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self) -> None:
        known = len(self.letters)
        if known == len(self.numbers):
            return
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        self.held += sum(map(len, fresh))
        words = [letters_of(w) for w in fresh]
        real = np.array([bool(w) for w in words])
        scores = np.zeros((len(words), len(self.model.languages)), np.float32)
        if real.any():
            spelled = [w for w in words if w]
            buckets, owners = gram_buckets(spelled)
            inside = owners < len(spelled)  # the last edge opens no word
            own = self.model.scores[buckets[inside]]
            for i in range(own.shape[1]):
                scores[real, i] = np.bincount(owners[inside], own[:, i], minlength=len(spelled))
            allowed = self.model.allowed[script_numbers(spelled)]
            barred = ~allowed & allowed.any(axis=1, keepdims=True)
            scores[real] -= 1000 * barred.astype(np.float32)
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, words), np.int64, len(words))])

    def look_up(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts that have letters' place in the tables, and the number of words per text."""
        if len(self.numbers) > WORD_LIMIT or self.held > CHAR_LIMIT:
            self._clear()
        words = [t.split() if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        self._learn()
        spelled = self.letters[numbers] > 0
        owner = np.repeat(np.arange(len(texts)), counts)
        return numbers[spelled], np.bincount(owner[spelled], minlength=len(texts))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; ``scores`` holds the words of all texts in a row, ``counts`` of each. All texts step together."""
    if not scores.size:
        return np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-counts[order], -np.arange(1, (counts.max() if len(counts) else 0) + 1), side="right")
    stays = np.zeros(scores.shape, bool)
    tops = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    total = np.zeros((len(counts), scores.shape[1]), np.float32)
    for step, n in enumerate(alive):
        now, at = total[:n], starts[:n] + step
        if step:
            top = now.argmax(axis=1)
            leave = now[np.arange(n), top] - penalty
            stay = now >= leave[:, None]
            tops[at], stays[at] = top, stay
            now = np.where(stay, now, leave[:, None])
            now -= now.max(axis=1, keepdims=True)
        total[:n] = now + scores[at]
    labels = np.zeros(len(scores), np.int64)
    current = total.argmax(axis=1)
    for step in range(len(alive) - 1, -1, -1):
        n = alive[step]
        at = starts[:n] + step
        labels[at] = own = current[:n]
        if step:
            current[:n] = np.where(stays[at, own], own, tops[at])
    return labels


def _span_rows(labels: np.ndarray, letters: np.ndarray, counts: np.ndarray, names: list[str]) -> pa.Array:
    """Spans of equal label of each text as arrays of (lang, words, letters)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    breaks = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    words = np.diff(np.append(breaks, len(labels)))
    spelled = np.add.reduceat(letters, breaks) if len(breaks) else letters
    spans = pa.StructArray.from_arrays(
        [pa.array([names[i] for i in labels[breaks]], pa.string()), pa.array(words, pa.int32()), pa.array(spelled, pa.int64())],
        ["lang", "words", "letters"],
    )
    ends = np.cumsum(np.bincount(owner[breaks], minlength=len(counts)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), spans)


SPAN_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int64())]))


def _labeller(model: Model, penalty: float, spans: bool):
    names = model.languages
    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), *[("spans", SPAN_TYPE)] * spans]

    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release_encoders()
        scorer = Scorer(model)
        for column in columns:
            parts = []
            for a, b, texts in text_ranges(column, BATCH_CHARS):
                numbers, counts = scorer.look_up(texts if names else [None] * (b - a))
                labels = viterbi(scorer.scores[numbers], counts, penalty)
                letters = scorer.letters[numbers]
                owner = np.repeat(np.arange(b - a), counts)
                shares = np.zeros((b - a, max(1, len(names))))
                np.add.at(shares, (owner, labels), letters)
                best, total = shares.argmax(axis=1), shares.sum(axis=1)
                own = [pa.array([names[i] if t else UNKNOWN for i, t in zip(best, total, strict=True)], pa.string())]
                own.append(pa.array(shares.max(axis=1) / np.maximum(total, 1), pa.float64()))
                if spans:
                    own.append(_span_rows(labels, letters, counts, names).cast(SPAN_TYPE))
                parts.append(pa.StructArray.from_arrays(own, [n for n, _ in kinds]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    return label


def predict(
    docs: DataFrame, model: Model, keep: Sequence[str] | None = None, penalty: float = SWITCH_PENALTY, spans: bool = False
) -> DataFrame:
    """Add lang_pred and score (and, if asked, the labelled spans in order) to the ``keep`` columns (all by default).

    Texts go to Python once and do not come back: the other columns stay where they are.
    """
    new = ["lang_pred", "score", *["spans"] * spans]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = "lang_pred string, score double" + ", spans array<struct<lang: string, words: int, letters: bigint>>" * spans
    label = F.arrow_udf(_labeller(model, penalty, spans), schema, ArrowUDFType.SCALAR_ITER)
    return docs.withColumn("_found", label(F.col("text"))).select(*kept, *[F.col(f"_found.{n}").alias(n) for n in new])
