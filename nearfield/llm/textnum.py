"""Vectorised hashing of texts: words, shingles and byte windows of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 20

_tables: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n-1, and its inverse's, modulo 2**64."""
    if len(_tables[0]) < n:
        size = max(n, 2 * len(_tables[0]), 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            t = np.full(size, b, U)
            t[0] = 1
            _tables[i] = np.multiply.accumulate(t)
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: Sequence[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together (one text is never cut)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Prefix:
    """Hashes of any byte range of a buffer, from sums of its bytes times powers of the base."""

    def __init__(self, buf: np.ndarray):
        p, self.inverse = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * p[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] ^ ((end - start).astype(U) << U(40)))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Bytes of a word that are hashed in steps of eight, all words at once; a longer word is hashed alone.
SHORT = 64


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end): words are runs of other bytes than 9-13 and 32.

    Eight bytes at a time are taken up by a bijection of 64 bits, so that words of up to eight bytes have hashes of their
    own and no sum of powers relates longer ones; words of over SHORT bytes have XXH3's."""
    whole = b"\n".join([*texts, b""]) + bytes(8)
    buf = np.frombuffer(whole, "u1")[:-8]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    gap = np.concatenate([[True], _SPACE[buf], [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    size = end - start
    eight = np.ndarray((max(len(whole) - 7, 1),), "<u8", whole, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(U) * U(_BASE))
    live, at = np.arange(len(start)), 0
    while len(live) and at < SHORT:
        if at:
            live = live[size[live] > at]
        out[live] = mix(out[live] ^ (eight[start[live] + at] & _MASK[np.minimum(size[live] - at, 8)]))
        at += 8
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[start[i] : end[i]])
    return out, np.searchsorted(start, begin)


def shingle_sets(texts: Sequence[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of its whole word sequence if that is shorter."""
    words, at = word_hashes(texts)
    p, _ = powers(n)
    some = max(0, len(words) - n + 1)
    all_ = np.zeros(some, U)
    for j in range(n):
        all_ += words[j : j + some] * p[j]
    all_ = mix(all_)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * p[: b - a]).sum(dtype=U)], U) + np.array([b - a], U) * U(_INVERSE)))
        else:
            out.append(np.empty(0, U))
    return out
