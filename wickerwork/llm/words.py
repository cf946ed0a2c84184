"""Hashes of all words of a batch of texts, in a few numpy passes over the batch's bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(step)
        done, step = done + take, step * step % 2**64
    return out


_kept_powers: dict[int, np.ndarray] = {}


def _first_powers(base: int, n: int) -> np.ndarray:
    """The first n powers; up to two million are kept for the next batch."""
    kept = _kept_powers.get(base)
    if kept is None or len(kept) < n:
        kept = _powers(base, max(n, 1 << 20))
        if len(kept) <= 1 << 21:
            _kept_powers[base] = kept
    return kept[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] for all spans at once: differences of a running polynomial, shifted back to power 0."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _first_powers(_BASE, len(values)), out=sums[1:])
    return (sums[stop] - sums[start]) * _first_powers(_INVERSE, len(values) + 1)[start]


class WordBatch:
    """hash: 64-bit hash of each word; start, end: its bytes in the batch's buffer; first[i]: index of text i's first word
    (first has one entry more than there are texts); offset[i]: where text i's bytes begin."""

    def __init__(self, texts: list[str], fold: bool):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(encoded) + b"\n", np.uint8)
        lengths = np.array([len(e) + 1 for e in encoded], np.int64)
        self.offset = 1 + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if encoded else np.zeros(0, np.int64)
        space = _SPACE[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = change[::2], change[1::2]
        self.data = data
        values = (_FOLD[data] if fold else data).astype(_U)
        values += _U(1)
        raw = span_hashes(values, self.start, self.end)
        self.hash = mix(raw + (self.end - self.start).astype(_U) * _MUL)
        self.first = np.concatenate([np.searchsorted(self.start, self.offset), [len(self.start)]]).astype(np.int64)


def pieces(texts: list, limit_bytes: int = 1_000_000):
    """Index ranges of texts whose sizes sum to about limit_bytes: bounds what a batch needs in memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > limit_bytes:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
