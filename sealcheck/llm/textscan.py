"""Vectorised scans over whole texts: words, lines, word shingles and their 64-bit hashes.

Texts are laid end to end as UTF-8 bytes, a line feed after each, so that one set of numpy calls serves many short texts.
White space is ``[\\x20\\x09-\\x0D]``, which no other UTF-8 byte can equal, so bytes and code points split alike.
Hashes are two polynomials modulo primes at random points (fixed, as all tasks must agree), taken from prefix sums and then mixed.
A modulus of 2**64 would not do: there, Thue-Morse strings of equal hash exist for every point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at once; a longer text is scanned alone.
CHUNK_BYTES = 1 << 20
WORDS_PER_SHINGLE = 5

_SAME = np.arange(1, 257, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Primes below 2**31 and a random point of each.
_FIELDS = [(2**31 - 1, 1_498_046_797), (2**31 - 19, 871_953_166)]
_powers = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in _FIELDS]


def _power_tables(size: int) -> list[list[np.ndarray]]:
    """Per field the powers of the point and of its inverse, grown by doubling."""
    for tables, (prime, point) in zip(_powers, _FIELDS):
        while len(tables[0]) < size:
            have = len(tables[0])
            for i, base in enumerate((point, pow(point, -1, prime))):
                more = tables[i].astype(np.uint64) * np.uint64(pow(base, have, prime)) % np.uint64(prime)
                tables[i] = np.concatenate([tables[i], more.astype(np.uint32)])
    return _powers


class PrefixHash:
    """Hashes of stretches of a sequence of symbols from 1 to below 2**31."""

    def __init__(self, symbols: np.ndarray):
        size = len(symbols)
        self._sums = []
        for (up, _), (prime, _) in zip(_power_tables(size + 1), _FIELDS):
            terms = symbols.astype(np.uint64) * up[:size]
            if size and int(symbols.max()) * prime * size >= 2**64:
                terms %= np.uint64(prime)
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal stretches wherever they are."""
        both = []
        for sums, (_, down), (prime, _) in zip(self._sums, _powers, _FIELDS):
            both.append((sums[end] - sums[start]) % np.uint64(prime) * down[start] % np.uint64(prime))
        return mix((both[0] | both[1] << np.uint64(31)) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def chunked(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) with at most ``limit`` bytes each, or one longer text. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts, first, held = [], 0, 0
    for row, text in enumerate(texts.cast(pa.binary())):
        text = text.as_py() or b""
        if parts and held + len(text) > limit:
            yield first, parts
            parts, first, held = [], row, 0
        parts.append(text)
        held += len(text)
    if parts:
        yield first, parts


class Scan:
    """Words (``start``, ``end``, ``doc``) of some texts; ``doc_start`` has one entry more than there are texts."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = self.docs_of(self.start)
        self.first_word = np.searchsorted(self.doc, np.arange(self.n + 1))
        self._hash: PrefixHash | None = None
        self._lower = lower

    def docs_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, places, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each stretch."""
        if self._hash is None:
            self._hash = PrefixHash((_LOWER if self._lower else _SAME)[self.data])
        return self._hash.of(start, end)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every line; a text has one line more than line feeds."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        return start, end, self.docs_of(start)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        if len(words) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(words) - size + 1
        total = np.zeros(last, np.uint64)
        for i in range(size):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[i:i + last]
        at = np.flatnonzero(self.doc[:last] == self.doc[size - 1:])
        return at, mix(total[at])

    def shingle_sets(self, size: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
        """Sorted distinct shingle hashes per text: all runs of ``size`` words, a shorter text as one, no words: empty."""
        words = self.word_hashes()
        at, hashes = self.windows(words, size)
        cut = np.searchsorted(at, self.first_word)
        sets = []
        for i in range(self.n):
            a, b = cut[i], cut[i + 1]
            if b > a:
                found = np.sort(hashes[a:b])
                if b - a > 1:
                    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                found = words[self.first_word[i]:self.first_word[i + 1]]
                if len(found):
                    total = np.full(1, len(found), np.uint64)
                    for w in found:
                        total = total * np.uint64(0xA0761D6478BD642F) + w
                    found = mix(total)
            sets.append(found)
        return sets
