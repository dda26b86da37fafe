"""Vectorised words, hashes and shingles over Arrow batches of texts.

A batch of texts is one run of UTF-8 bytes; words, lines and windows are found with numpy over that run, so the
Python work for each document is small.  Words are ``[^\\x20\\x09-\\x0D]+``; null texts count as empty.
All hashes are 64 bits, from a seeded byte table, and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is still taken whole.
CHUNK = 1 << 21

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Texts:
    """Some texts as one run of bytes, with the words of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds.astype(np.int64)
        self.n = len(bounds) - 1
        self._prefix: np.ndarray | None = None

    @cached_property
    def inside(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def starts(self) -> np.ndarray:
        before = np.empty_like(self.inside)
        if len(before):
            before[0] = False
            before[1:] = self.inside[:-1]
            edges = self.bounds[:-1]
            before[edges[edges < len(before)]] = False
        return np.flatnonzero(self.inside & ~before)

    @cached_property
    def ends(self) -> np.ndarray:
        after = np.empty_like(self.inside)
        if len(after):
            after[-1] = False
            after[:-1] = self.inside[1:]
            ends = self.bounds[1:]
            after[ends[ends > 0] - 1] = False
        return np.flatnonzero(self.inside & ~after) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """Word numbers at which each text begins, with the end of the last."""
        return np.searchsorted(self.starts, self.bounds)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[start:end] for each pair."""
        up, down = powers(len(self.data))
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts] + (ends - starts).astype(U64))

    def words(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = words[:n] * _ORDER[0]
    for j in range(1, k):
        out = out + words[j : j + n] * _ORDER[j]
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of a text's k-word shingles: with fewer words the whole sequence as one, without words none."""
    if 0 < len(words) < k:
        return windows(words, len(words)) ^ U64(len(words))
    out = np.sort(windows(words, k))
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, Texts) for runs of about CHUNK bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, buffers = len(texts), texts.buffers()
    if not n:
        return
    bounds = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        yield at, Texts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], lower)
        at = to
