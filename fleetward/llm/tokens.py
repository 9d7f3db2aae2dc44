"""Vectorised word and shingle hashing for the operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_RNG = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_BLANK[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    pw = powers(0xD6E8FEB86659FD93 + 2 * seed, int(lengths.max()))
    keep = ~_IS_BLANK[data]
    own = _BYTE[data[keep]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(own)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(own * pw[place], first) + lengths.astype(np.uint64) * _GOLDEN)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """A fixed random number for each byte."""
    return _BYTE[data]


def window_hashes(symbols: np.ndarray, k: int, well_mixed: bool = True) -> np.ndarray:
    """Hash of each run of k symbols, by doubling: a run of a + b symbols from runs of a and of b.

    well_mixed: mixes between the doublings; without, the hash is linear in the symbols until its end, and faster.
    """
    between = mix if well_mixed else (lambda x: x)
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    run, have, out, done = symbols, 1, None, 0
    while True:
        if k & have:
            tail = run[done : done + n]
            out = tail if out is None else between(out * _M1 + tail)
            done += have
        if done == k:
            return mix(out + np.uint64(k))
        run = between(run[:-have] * (_GOLDEN + np.uint64(2 * have)) + run[have:])
        have *= 2


def batch_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each begins (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in raw], out=at[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), at


def slices(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, so that what is worked out of each text is never held for a whole batch."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.iloc[a : a + rows].reset_index(drop=True)
