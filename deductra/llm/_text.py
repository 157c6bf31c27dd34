"""Words, digests and hashes of texts.

Items of a text are told apart by BLAKE2b digests of their bytes, never by an algebraic hash,
which structured texts can make collide; sequences of items are told apart by a digest
of the items' digests. ``prefix`` and ``between`` are a fast polynomial hash for picking
places only: no equality rests on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
#: A random value for each byte.
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 5
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longest word and most words that a worker remembers.
LONG, REMEMBERED = 40, 300_000

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below at least ``n``."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        pair = []
        for b in (base, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            filled = 1
            while filled < size:
                step = U(pow(b, filled, 2**64))
                p[filled : 2 * filled] = p[:filled] * step
                filled *= 2
            pair.append(p)
        have = _powers[base] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One value for each ordered pair, not linear in either."""
    return mix(mix(x) * GOLDEN + y)


def prefix(x: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of x[i] * base**i; ``between`` takes hashes out of them."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(base, len(x) + 1)[0][: len(x)], out=out[1:])
    return out


def word_spans(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't in ``space``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Digests(dict):
    """Word -> the 16 bytes of its digest. Long words aren't kept, and not more than ``REMEMBERED`` ones."""

    def __missing__(self, word: bytes) -> bytes:
        d = blake2b(word, digest_size=16).digest()
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = d
        return d


_digests = _Digests()


def word_digests(words: Iterable[bytes]) -> np.ndarray:
    """A row of two 64-bit values for each word: its 128-bit digest."""
    return np.frombuffer(b"".join(map(_digests.__getitem__, words)), "<u8").reshape(-1, 2)


#: Maximal runs of bytes other than space and \x09-\x0D are what ``bytes.split`` gives.
words = bytes.split
#: Letters and digits; bytes of other scripts count as letters.
alphanumeric = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of ``n`` consecutive words (64-bit values), sorted; fewer words: the whole sequence as one; none: empty."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        h = join(h, words[j : len(words) - n + 1 + j])
    return np.unique(mix(h + U(n)))


def span_digests(data: memoryview | bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A row of two 64-bit values for each stretch data[lo:hi]: its 128-bit digest."""
    data = memoryview(data)
    return np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())]), "<u8").reshape(-1, 2)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a sorted set, as two signed values."""
    one, two = np.frombuffer(blake2b(np.ascontiguousarray(s).tobytes(), digest_size=16).digest(), "<i8")
    return int(one), int(two)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty. Lone surrogates, which UTF-8 can't hold, become ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")
