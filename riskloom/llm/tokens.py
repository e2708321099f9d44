"""Token ids of whole texts by a public tokenizer file, batch by batch inside Spark tasks.

Encoding a text as one string spends most of its time on words the worker has met before. Here a text is cut at single
spaces, where every pre-tokenizer of the supported files cuts too, each distinct word is encoded once, and the ids of
a text are gathered from the table of words with numpy. A text whose spaces touch other white space is encoded whole.
Both ways give the same ids (``tests/llm/test_tokens.py``).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters that no normalization rule changes beyond lower case
MARKS = ".,;:?!"
PLAIN = re.compile(rf"[{LETTERS}]+\Z")
# a word of letters with its space; marks up to white space; one line break inside running text; all the rest
PIECES = re.compile(
    rf" ?[{LETTERS}]+(?=[\n{MARKS}]|\Z)|[{MARKS}]+(?=\n|\Z)|(?<=[{LETTERS}{MARKS}])\n(?=[{LETTERS}])|.+", re.DOTALL
)
WORD_LIMIT, CHAR_LIMIT = 1_000_000, 1 << 24  # words kept per worker, and their characters; beyond them the table starts anew


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in names)
    names |= {b: chr(256 + i) for i, b in enumerate(others)}
    return [names[b] for b in range(256)]


class _Numbers(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Ids of texts by the tokenizer file at ``path`` (``add_special_tokens=False``); one per task.

    Strings that spell a special token inside a text get that token's id, as the library does by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        normalizer, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # How a plain word reaches the merges is learned from the file's own rules, not assumed.
        probe = " Aé" if normalizer is None else normalizer.normalize_str(" Aé")
        seen = [part for part, _ in split.pre_tokenize_str(probe)]
        letters = byte_letters()
        self.table = {i: letters[i] for i in range(256)}
        spaced, folded = "".join(letters[b] for b in " Aé".encode()), "".join(letters[b] for b in "aé".encode())
        self.form = "spaced" if seen == [spaced] else "folded" if seen == [folded] else None
        self._part = lru_cache(1 << 16)(self._piece)  # marks, line breaks, first words of lines
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.numbers = _Numbers()
        self.flat, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1, np.int64)
        self.edge = np.zeros(0, np.int8)

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece; a plain word goes straight to the merges."""
        word = piece[1:] if piece[:1] == " " else piece
        if self.form and word.isalpha() and (word.isascii() or PLAIN.match(word)):
            word = word if self.form == "spaced" else word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.table)
            if self.form == "spaced" and piece[0] == " ":
                word = self.table[32] + word
            return [token.id for token in self.model.tokenize(word)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _known(self, piece: str) -> list[int]:
        """Ids of a piece, from the table where the piece is a word there."""
        number = self.numbers.get(piece[1:] if piece[0] == " " else " " + piece, len(self.ends))
        if number < len(self.ends) - 1:
            return self.flat[self.ends[number] : self.ends[number + 1]].tolist()
        return self._part(piece)

    def _word(self, key: str) -> list[int]:
        """Ids of a word; a leading space in ``key`` marks the first word of a text, which has none there."""
        text = key[1:] if key[:1] == " " else " " + key
        if key.isalpha():
            return self._piece(text)
        if key[:-1].isalpha() and key[-1] in MARKS and (key.isascii() or PLAIN.match(key[:-1])):
            return self._known(text[:-1]) + self._part(key[-1])
        if not text.strip(" "):
            return []
        return list(chain.from_iterable(map(self._known, PIECES.findall(text))))

    def _learn(self) -> None:
        known = len(self.ends) - 1
        if known == len(self.numbers):
            return
        words = list(self.numbers)[known:] if known == 0 else list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        self.held += sum(map(len, words))
        fresh = [self._word(word) for word in words]
        ends = self.ends[-1] + np.cumsum([len(ids) for ids in fresh])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), int(ends[-1])), np.uint32)])
        self.flat[self.ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(fresh), np.uint32)
        self.ends = np.concatenate([self.ends, ends])
        # 1: no other word may follow; 2: no other word may stand before it
        edge = np.zeros(len(words), np.int8)
        for i, word in enumerate(words):
            if not word.isalpha() and (not word or word[-1].isspace() or word[0].isspace()):
                edge[i] = (not word or word[-1].isspace()) + 2 * (not word or word[0] != " " and word[0].isspace())
        self.edge = np.concatenate([self.edge, edge])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the number of ids of each text (none for null)."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short lists without cycles: looking for cycles among them takes an eighth of the time
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > WORD_LIMIT or self.held > CHAR_LIMIT:
            self._clear()
        words = [t.split(" ") if t else [] for t in texts]
        for own in words:
            if own:
                own[0] = " " + own[0]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = int(counts.sum())
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, total)
        self._learn()
        ids, per_word = gather(self.flat, self.ends, numbers)
        stops = np.cumsum(counts)
        bounds = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], stops])]
        lengths = np.diff(bounds)
        edge = self.edge[numbers]
        edge[stops[counts > 0] - 1] &= 2
        whole = np.unique(np.searchsorted(stops, np.flatnonzero(edge), side="right"))
        if len(whole):
            parts = np.split(ids, bounds[1:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths


def shared_encoder(path: str) -> Encoder:
    """The encoder of this Python worker for ``path``.

    Functions travel to the executors by value and so have no module of their own there; the table of words is kept
    on the tokenizers module, so that the tasks of one worker share it.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_riskloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def release_encoders() -> None:
    """Drop the word tables of this worker and hand their memory back: tasks of other operators call it, so that the tables do not add up."""
    module = sys.modules.get("tokenizers")
    if module is not None:
        vars(module).pop("_riskloom_encoders", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def gather(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the stretches ``flat[ends[n]:ends[n + 1]]`` of the given numbers; also their lengths."""
    lengths = ends[numbers + 1] - ends[numbers]
    shift = np.repeat(ends[numbers] - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(len(shift)) + shift], lengths


def batches_by_size(texts: Sequence[str | None], limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters, so that work space stays bounded."""
    ranges, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= limit:
            ranges.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(texts):
        ranges.append((start, len(texts)))
    return ranges


def text_ranges(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of a text column of about ``limit`` bytes each, with their texts; only one range is held at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(column)], strict=True):
        yield a, b, column.slice(a, b - a).to_pylist()


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
