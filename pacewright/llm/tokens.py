"""Words of whole texts as public vocabularies cut them, and values of those words, slice by slice.

A slice of a text column becomes one array of code points; the vocabulary's splitting rule is applied
to all its texts at once through character classes, and every word gets a 64-bit hash. Only words that
a bounded cache does not hold are given to the function that values a word (the ``tokenizers``
library's ids, or the prefix program's counts); all else is array work.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from pacewright.llm.textgrid import SLICE_BYTES, mixed, powers_to, text_slices

#: Words that one encoder keeps: with their ids about 100 MB, whatever the corpus.
CACHE_WORDS = 300_000
LETTER, NUMBER, SPACE, OTHER, SPECIAL = range(5)


def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, by the terms of the vocabulary's pattern."""
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


@functools.cache
def _point_values() -> np.ndarray:
    return np.random.default_rng(20240317).integers(1, 1 << 64, 0x110000, dtype=np.uint64) | np.uint64(1)


def _word_starts(points: np.ndarray, breaks: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words of the pattern begin.

    The pattern: a contraction ('s 't 'm 'd 're 've 'll); else a run of letters, of numbers or of
    other characters, with one space before it if there is one; else white space, without its
    last character if more text follows. ``breaks`` marks where a text (or a part of it) begins.
    """
    n = len(points)
    start = breaks[:n].copy()
    if n < 2:
        return np.flatnonzero(start)
    start[1:] |= kinds[1:] != kinds[:-1]
    white = kinds == SPACE
    follows = np.zeros(n, dtype=bool)  # the next character belongs to the same part and is not white space
    follows[:-1] = ~white[1:] & ~breaks[1:n]
    last = white & follows
    start |= last  # the last white space of a run stands alone, or leads the next word if it is a space
    lead = last & (points == 0x20)
    lead[:-1] &= kinds[1:] != SPECIAL
    start[1:] &= ~lead[:-1]
    # contractions: a lone ' that begins a word, followed by one of the endings
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kinds[1:] == LETTER) & ~breaks[1:n])
    if len(mark):
        second = points[mark + 1]
        third = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        third[(mark + 2 < n) & breaks[np.minimum(mark + 2, n)]] = 0
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (second == ord(a)) & (third == ord(b))
        start[mark[one | two] + 1] = False
        for at in (mark[one] + 2, mark[two] + 3):
            start[at[at < n]] = True
    return np.flatnonzero(start)


class _Store:
    """Values of words by number: an amount each, and the ids that make it up where values are arrays."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.amount, self.begin, self.flat = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.uint32)

    def add(self, values: list) -> int:
        """Adds values, all numbers or all lists of ids; returns the first one's number."""
        first, self.n = self.n, self.n + len(values)
        while self.n > len(self.amount):
            self.amount, self.begin = np.resize(self.amount, 2 * len(self.amount)), np.resize(self.begin, 2 * len(self.begin))
        if isinstance(values[0], int):
            self.amount[first : self.n] = values
            return first
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        ends = self.used + np.cumsum(sizes)
        self.amount[first : self.n], self.begin[first : self.n] = sizes, ends - sizes
        total = int(ends[-1])
        while total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : total] = np.fromiter(chain.from_iterable(values), np.uint32, total - self.used)
        self.used = total
        return first


@dataclass
class Slice:
    """The words of some consecutive texts; ``place`` is each word's number in ``store``."""

    row: int
    place: np.ndarray
    store: _Store
    word_at: np.ndarray  # n+1: each text's first word
    char_at: np.ndarray  # n+1: each text's first code point
    byte_at: np.ndarray  # n+1: each text's first byte
    starts: np.ndarray  # each word's first code point
    points: np.ndarray

    def word(self, i: int) -> str:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.points)
        return self.points[self.starts[i] : end].tobytes().decode("utf-32-le")

    def text(self, a: int, b: int) -> str:
        return self.points[a:b].tobytes().decode("utf-32-le")


class WordValues:
    """``slices(column)``: the words of a text column with ``of_word``'s value for each different word.

    ``of_words`` takes a list of words and gives a list of values, each an array of ids or a number.
    Words are cut by the byte-level vocabularies' pattern, or, if ``apart`` is given, before every run
    of spaces (or of the marks they are written as) and wherever ``apart`` says, by their code points,
    that two characters never share a token.
    """

    def __init__(self, of_words: Callable, special: tuple[str, ...] = (), apart: np.ndarray | None = None, most: int = CACHE_WORDS):
        self._of_words, self._special, self._apart, self._most = of_words, special, apart, most
        self._known: dict[int, int] = {}
        self._store = _Store()

    def slices(self, column: pa.Array) -> Iterator[Slice]:
        for row, data, byte_at in text_slices(column, SLICE_BYTES):
            raw = data.tobytes()
            text = raw.decode("utf-8")
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            if len(points) == len(data):
                char_at = byte_at
            else:
                char_at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[byte_at]
            breaks = np.zeros(len(points) + 1, dtype=bool)
            breaks[char_at] = True
            if self._apart is not None:
                space = (points == 0x20) | (points == 0x2581)
                start = breaks[:-1] | space
                start[1:] &= ~(space[1:] & space[:-1]) | breaks[1:-1]
                known = np.minimum(points, len(self._apart) - 1)
                start[1:] |= self._apart[known[:-1], known[1:]]
                starts = np.flatnonzero(start)
            else:
                starts = _word_starts(points, breaks, self._kinds(text, points, breaks))
            place = self._places(text, points, starts)
            yield Slice(row, place, self._store, np.searchsorted(starts, char_at), char_at, byte_at, starts, points)

    def _kinds(self, text: str, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Classes of the code points; special strings are a class of their own, with breaks around them."""
        kinds = _classes()[points]
        for s in self._special:
            at = text.find(s)
            while at >= 0:
                if breaks[at + 1 : at + len(s)].any():  # it runs over the end of a text
                    at = text.find(s, at + 1)
                    continue
                kinds[at : at + len(s)] = SPECIAL
                breaks[[at, at + len(s)]] = True
                at = text.find(s, at + len(s))
        return kinds

    def _places(self, text: str, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(points)
        if not len(starts):
            return starts
        power, inverse = powers_to(n + 1)
        running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_point_values()[points] * power[:n], out=running[1:])
        ends = np.append(starts[1:], n)
        codes, different = pd.factorize(mixed((running[ends] - running[starts]) * inverse[starts]))
        del running
        if len(self._known) + len(different) > max(self._most, len(different)):
            self._known, self._store = {}, _Store()
        known = self._known
        hashes = different.tolist()
        place = np.array([known.get(h, -1) for h in hashes], dtype=np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))[new]
            words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            begin = self._store.add(list(self._of_words(words)))
            place[new] = np.arange(begin, begin + len(new))
            known.update(zip((hashes[k] for k in new.tolist()), range(begin, begin + len(new)), strict=True))
        return place[codes]


def gathered(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice whose values are arrays of ids, and where each text's ids begin (n+1)."""
    each = s.store.amount[s.place]
    at = np.concatenate(([0], np.cumsum(each)))
    return s.store.flat[np.repeat(s.store.begin[s.place] - at[:-1], each) + np.arange(at[-1])], at[s.word_at]


class TextEncoder:
    """``texts(column)``: for each text, in order, the library's ids of the whole text (a null text has none).

    ``control`` names further strings that are tokens of their own, like the vocabulary's special ones.
    """

    def __init__(self, name: str = "byte_bpe_50k.json", most: int = CACHE_WORDS, control: tuple[str, ...] = ()):
        tok = tokenizer(name)
        if control:
            tok.add_special_tokens(list(control))
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        letters = letters_of_bytes()
        tokenize = tok.model.tokenize

        def of_words(words: list[str]) -> Iterator[list[int]]:
            for word in words:
                if word in special:
                    yield [special[word]]
                else:
                    yield [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]

        self._words, self._tok = WordValues(of_words, tuple(special), most=most), tok

    def slices(self, column: pa.Array) -> Iterator[Slice]:
        return self._words.slices(column)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        for s in self._words.slices(column):
            ids, at = gathered(s)
            bounds = at.tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b]

    @functools.cached_property
    def _bytes(self) -> np.ndarray:
        """The bytes of each id: a letter of a token stands for one byte, special strings for themselves."""
        special = self._tok.get_added_tokens_decoder()
        vocabulary = self._tok.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token.encode()) if i in special else len(token)
        return sizes

    def offsets(self, s: Slice, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's first code point in the slice and the one after its last; a token that holds a part of a
        character reaches over all of it."""
        sizes = self._bytes[ids]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if len(s.points) == s.byte_at[-1]:
            return begins, ends
        p = s.points
        of_byte = np.repeat(np.arange(len(p)), 1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF))
        return of_byte[begins], of_byte[ends - 1] + 1


def letters_of_bytes() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
